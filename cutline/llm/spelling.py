"""Grouping of spelling variants through a dictionary of trie-node pairs.

The nodes of a trie of the words, and of a trie of the reversed words, are numbered; a node is a prefix or a suffix. At
every place of a word there are two pairs of numbers: (prefix before it, suffix after it) with one letter skipped, and
(prefix before it, suffix from it) with none. Words that skip a letter to the same pair differ in that letter alone; a
word that skips to a pair which is another word's plain pair has one letter more. So one exchange on pairs of integers
finds all neighbours exactly.

A pair's group is small whatever the corpus: those that skip to it are one word per letter of the alphabet, and only one
word is the plain pair itself. Neighbours are therefore counted inside the group, and no list of them leaves it.
"""

from __future__ import annotations

import os
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import saved, table
from cutline.plans.pooled import lookup

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
LENGTH_BITS = 28  # of a node's number; the others hold the rank of a word
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_words(docs: DataFrame, least_letters: int = 7, least: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n`` of the texts' letter runs, after one letter is deleted from one run in 31 (a planted misspelling).

    Runs are maximal, and A-Z are lowered. The deletion is drawn by crc32 of ``id:run``; a NULL id counts as an empty
    one. Runs too short to give a word are left out by the pattern itself.
    """
    runs = docs.selectExpr(
        f"coalesce(CAST(`{id}` AS STRING), '') AS _id",
        f"explode(regexp_extract_all(`{text}`, '{LETTERS}{{{least_letters},}}+', 0)) AS _run",
    ).selectExpr("_id", f"translate(_run, '{CAPITALS}', '{CAPITALS.lower()}') AS _run")
    drawn = runs.selectExpr("_run", "crc32(CAST(concat(_id, ':', _run) AS BINARY)) AS _h")
    at = "CAST(_h % char_length(_run) AS INT)"
    words = drawn.selectExpr(f"CASE WHEN _h % 31 = 0 THEN concat(substr(_run, 1, {at}), substr(_run, {at} + 2)) ELSE _run END AS word")
    return (
        words.where(f"char_length(word) >= {least_letters}").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {least}")
    )


def _owners(words: DataFrame, key: str, size: int = 1 << 20) -> DataFrame:
    """Rows in order of ``key`` with the trie nodes their key runs through: ``key, w, n, part, k, owners, first``.

    ``part`` is the range the row was dealt to and ``k`` its place there. ``owners[i]`` is the place of the first row of
    the range that shares the key's first i letters: it creates the node, the others meet it. One pass compares each key
    with the one before; about ``size`` owners are held at once, or those of one longer key. ``first`` marks letters that
    differ from the letter before.
    """
    names, kinds = ["key", "w", "n", "part"], [pa.string(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches):
        before, owners, k = "", [], 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            low, flat, first, sizes = 0, [], [], [0]
            for at, key in enumerate(keys, start=1):
                same = 0
                for x, y in zip(key, before):
                    if x != y:
                        break
                    same += 1
                del owners[same + 1 :]
                owners.extend([k] * (len(key) + 1 - len(owners)))
                flat.extend(owners)
                if key:
                    first.append(True)
                    first.extend(map(ne, key[1:], key))
                sizes.append(len(flat))
                before, k = key, k + 1
                if at < len(keys) and len(flat) < size:
                    continue
                starts = np.array(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(low, at - low).cast(t) for c, t in zip(names, kinds)],
                        pa.array(np.arange(k - (at - low), k)),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(flat, pa.int64())),
                        pa.ListArray.from_arrays(pa.array(starts - np.arange(len(starts)), pa.int32()), pa.array(first, pa.bool_())),
                    ],
                    [*names, "k", "owners", "first"],
                )
                low, flat, first, sizes = at, [], [], [0]

    dealt = words.repartitionByRange(key).sortWithinPartitions(key)
    return dealt.selectExpr(f"{key} AS key", "w", "n", "spark_partition_id() AS part").mapInArrow(
        run, "key string, w long, n long, part int, k long, owners array<long>, first array<boolean>"
    )


def _numbered_nodes(words: DataFrame, key: str, purpose: str) -> DataFrame:
    """``key, w, n, rank, nodes, first``: rank of the row in order of ``key``, and the number of the node of each prefix.

    A node's number is made of the rank of the first row that has the prefix, and the prefix's length. Ranges meet only
    at their ends: what the last key of one shares with the first of the next. Those two keys of every range come to
    the driver, which hands the numbers on from range to range.
    """
    held = saved(_owners(words, key), purpose)
    ends = (
        held.groupBy("part").agg(F.expr("min(key) AS low"), F.expr("max(key) AS high"), F.expr("count(1) AS size"),
                                 F.expr("max_by(owners, k) AS owners")).orderBy("part").collect()
    )
    rows, offset, last, nodes = [], 0, "", []
    for end in ends:
        shared = len(os.path.commonprefix([last, end.low]))
        carried = nodes[: shared + 1] if rows else []
        rows.append((end.part, offset, carried))
        nodes = [
            carried[i] if owner == 0 and i < len(carried) else (offset + owner) << LENGTH_BITS | i
            for i, owner in enumerate(end.owners)
        ]
        offset, last = offset + end.size, end.high
    known = words.sparkSession.createDataFrame(rows, "part int, offset long, carried array<long>")
    number = (
        "transform(owners, (o, i) -> CASE WHEN o = 0 AND i < size(carried) THEN carried[i] "
        f"ELSE shiftleft(offset + o, {LENGTH_BITS}) | CAST(i AS BIGINT) END)"
    )
    # one row per range
    return held.join(F.broadcast(known), "part").selectExpr(
        "key", "w", "n", "offset + k AS rank", f"{number} AS nodes", "first"
    )


def pair_dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (word, n) with their numbers ``w, word, n``, and their pairs ``p, s, w, n, skips, first``.

    Numbers follow the order of words by code point. ``skips`` tells pairs that leave a letter out; ``first`` marks the
    first of equal letters in a row, as skipping any of them gives one result.
    """
    ahead = saved(_numbered_nodes(words.selectExpr("word", "0L AS w", "n"), "word", "trie"), "trie")
    numbered = ahead.selectExpr("rank AS w", "key AS word", "n")
    back = _numbered_nodes(numbered.selectExpr("w", "reverse(word) AS drow", "n"), "drow", "trie").selectExpr("w", "nodes AS ends")
    plain = "transform(nodes, (p, i) -> named_struct('p', p, 's', ends[size(ends) - 1 - i], 'skips', false, 'first', false))"
    skips = "transform(first, (f, i) -> named_struct('p', nodes[i], 's', ends[size(ends) - 2 - i], 'skips', true, 'first', f))"
    pairs = ahead.selectExpr("rank AS w", "n", "nodes", "first").join(back, "w").selectExpr(
        "w", "n", f"inline(concat({plain}, {skips}))"
    )
    return numbered, pairs


def neighbours(pairs: DataFrame) -> DataFrame:
    """``w, n_near, best``: how many words are near each word that has any, and the most frequent as (-n, w)."""
    groups = (
        pairs.groupBy("p", "s").agg(F.expr("collect_list(struct(w, n, skips, first)) AS words")).where("size(words) > 1")
    )
    near = "(m.skips AND x.skips) OR (m.skips AND m.first AND NOT x.skips) OR (x.skips AND x.first AND NOT m.skips)"
    found = groups.selectExpr(
        "inline(transform(words, m -> named_struct('w', m.w, 'near', "
        f"transform(filter(words, x -> x.w <> m.w AND ({near})), x -> struct(-x.n AS n, x.w AS w)))))"
    )
    return found.where("size(near) > 0").groupBy("w").agg(
        F.expr("CAST(sum(size(near)) AS BIGINT) AS n_near"), F.expr("min(array_min(near)) AS best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """Follow (w, form) to the last: each round doubles the steps taken. Counts rise at every step, so there is no ring."""
    here = forms.selectExpr("w", "form AS root")
    while True:
        ahead = lookup(here, here.selectExpr("w AS root", "root AS _next"), ["root"])
        moved = saved(ahead.selectExpr("w", "coalesce(_next, root) AS root", "_next IS NOT NULL AS _moved"), "roots")
        here = moved.select("w", "root")
        if moved.where("_moved").isEmpty():
            return here


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with their counts (word, n).

    Near words differ by exactly one code point inserted, deleted or replaced. A word's form is its near word with the
    largest n, then the smallest in code-point order, if it is at least ``factor`` times as frequent; ``root`` follows
    forms to the last. Words without a form are their own root. ``factor`` above 1 keeps chains finite. Long words are
    no special case: each place costs the same. A word of NULL is left out; other columns are ignored; no rows give none.
    """
    given = saved(words.where("word IS NOT NULL").select("word", "n"), "spelling")
    numbered, pairs = pair_dictionary(given)
    near = saved(neighbours(pairs), "spelling")
    judged = saved(
        numbered.join(near, "w", "left").selectExpr(
            "word", "w", "n", "coalesce(n_near, 0L) AS n_near",
            f"CASE WHEN -best.n >= {factor} * n THEN best.w END AS form", f"CASE WHEN -best.n >= {factor} * n THEN -best.n END AS form_n",
        ),
        "spelling",
    )
    alone = judged.where("form IS NULL").selectExpr("word", "CAST(NULL AS STRING) AS form", "word AS root", "n", "n_near", "form_n")
    forms = judged.where("form IS NOT NULL")
    named = lookup(forms, numbered.selectExpr("w AS form", "word AS _form"), ["form"])
    rooted = lookup(_roots(forms), numbered.selectExpr("w AS root", "word AS _root"), ["root"]).selectExpr("w", "_root")
    return alone.union(
        named.join(rooted, "w").selectExpr("word", "_form AS form", "_root AS root", "n", "n_near", "form_n")
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All letter runs of ``documents``, each a word or a planted misspelling of one; NULL texts have none."""
    return group_variants(count_words(table(spark, sf_dir, "documents")))


SQL = """
WITH bits AS (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS code
  FROM range(256) AS t(i)
), codes AS (
  SELECT list(code ORDER BY i) AS of FROM bits
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7
  GROUP BY ALL
), hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(
      list_transform(range(1, 1 + octet_length(encode(name))), lambda i: CAST('0x' || substr(hex(encode(name)), 2 * i - 1, 2) AS BIGINT)),
      lambda c, b: xor(c >> 8, of[CAST(xor(c & 255, b) AS INT) + 1]), 4294967295)) AS h
  FROM (SELECT run, k, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name FROM runs), codes
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
                  ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), skipped AS (
  SELECT word, n, i, left(word, CAST(i AS INT)) AS a, substr(word, CAST(i AS INT) + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), links AS (
  SELECT x.word, y.word AS other, y.n AS m FROM skipped x JOIN skipped y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM skipped x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM skipped x JOIN words y ON y.word = x.a || x.b
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM links GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form,
         CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chains AS (
  WITH RECURSIVE c AS (
    SELECT word, form AS goal, 1 AS step FROM judged WHERE form IS NOT NULL
    UNION ALL SELECT c.word, j.form, step + 1 FROM c JOIN judged j ON c.goal = j.word WHERE j.form IS NOT NULL
  ) SELECT word, last(goal ORDER BY step) AS root FROM c GROUP BY word
)
SELECT j.word, form, coalesce(root, j.word) AS root, n, n_near, form_n FROM judged j LEFT JOIN chains c ON j.word = c.word
"""
