"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts. DataFrame functions only.

Every row gets a random key, the hash of its id and text. The keys of a source are cut into ranges of equal width, as
many as a range then has rows of the whole table: neither grows beyond its square root. Words are summed by (source, range), and a running sum over
the ranges finds the one in which the source's budget ends. Only the rows of that range are sorted by key, and a second
running sum gives the key at which the source is cut. The plan of a mix is therefore one row per source, and applying it
to the rows needs no further shuffle: rows below the cut are taken once more than rows above it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import broadcast_within, saved, table
from cutline.plans.pooled import lookup

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
_SOURCE = ["_none", "_source"]  # a NULL source comes last and is no other's equal


def running(df: DataFrame, order: Sequence[str], values: Mapping[str, str], purpose: str) -> DataFrame:
    """Running sums (name -> SQL text) over all rows in a total order, the row itself included.

    Rows are dealt by range and written down; each partition then starts from the sums of those before it. The only
    window without a key is over one row per partition.
    """
    dealt = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), purpose)
    sums = dealt.groupBy("_part").agg(*[F.expr(f"sum({v}) AS _t_{n}") for n, v in values.items()])
    starts = sums.selectExpr(
        "_part AS _p",
        *[
            f"coalesce(sum(_t_{n}) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _s_{n}"
            for n in values
        ],
    )
    by = ", ".join(order)
    return dealt.join(F.broadcast(starts), F.expr("_part = _p")).selectExpr(
        *df.columns,
        *[
            f"_s_{n} + sum({v}) OVER (PARTITION BY _part ORDER BY {by} ROWS UNBOUNDED PRECEDING) AS {n}"
            for n, v in values.items()
        ],
    )


def targets(sources: DataFrame, weights: Sequence[int], share: Fraction, most: int) -> DataFrame:
    """Add ``target`` to sources (_none, _source, source_size): words by weight, at most ``most`` times the source's size.

    Weights repeat over the sources in order of name, by code point, NULL last. What a source cannot hold is shared
    among the others by weight. In order of size to weight the full sources come first, so that a source is full
    exactly if it would be with all sources before it full: one running sum decides all of them, in whole numbers.
    """
    steps = math.lcm(*weights)
    weighted = running(sources, _SOURCE, {"_rank": "1"}, "mix").withColumn(
        "_weight", F.expr(f"element_at(array({', '.join(map(str, weights))}), CAST((_rank - 1) % {len(weights)} AS INT) + 1)")
    )
    ordered = saved(
        running(
            weighted.withColumn("_ratio", F.expr(f"source_size * ({steps} DIV _weight)")),
            ["_ratio", *_SOURCE], {"_sizes": "source_size", "_weights": "_weight"}, "mix",
        ),
        "mix",
    )
    total, weight = ordered.agg(F.sum("source_size"), F.sum("_weight")).first()
    if total is None:
        return sources.withColumn("target", F.lit(0.0))
    top, bottom = share.numerator, share.denominator

    def big(sql: str | int) -> str:
        return f"CAST({sql} AS DECIMAL(19, 0))"

    full = (
        f"{big('_weight')} * {big(f'{top * total} - {bottom * most} * (_sizes - source_size)')}"
        f" >= {big(f'{bottom * most} * source_size')} * {big(f'{weight} - _weights + _weight')}"
    )
    marked = ordered.withColumn("_full", F.expr(full))
    held, gone = marked.agg(
        F.expr("coalesce(sum(CASE WHEN _full THEN source_size END), 0)"),
        F.expr("coalesce(sum(CASE WHEN _full THEN _weight END), 0)"),
    ).first()
    # a literal below 2^31 is an INT, and so would be its product with a weight
    rest = f"CAST({big('_weight')} * {big(top * total - bottom * most * held)} AS DOUBLE) / {max(bottom * (weight - gone), 1)}"
    return marked.select(
        *_SOURCE, "source_size",
        F.expr(f"CASE WHEN _full THEN CAST({most} * source_size AS DOUBLE) ELSE {rest} END AS target"),
    )


def _keyed(docs: DataFrame, seed: str, id: str, text: str, source: str, *more: str) -> DataFrame:
    """Rows as ``doc_id, _none, _source, size, _key``, with more columns as SQL text."""
    whole = f"coalesce(`{text}`, '')"
    return docs.selectExpr(
        f"CAST(`{id}` AS BIGINT) AS doc_id", f"`{source}` IS NULL AS _none", f"coalesce(`{source}`, '') AS _source",
        f"CAST(regexp_count({whole}, '{WORD}') AS BIGINT) AS size",
        f"md5(concat('{seed}:', coalesce(CAST(`{id}` AS STRING), ''), ':', {whole})) AS _key",
        *more,
    )


def _plan(base: DataFrame, weights: Sequence[int], share: Fraction, most: int) -> DataFrame:
    """One row per source: its size and target, how often it is taken whole, and where the rest of its budget ends.

    ``passes``: whole passes; ``_cut``: the key of the row that takes ``_words`` words of the rest, of ``_n`` equal rows.
    Sources whose budget ends with a pass have no ``_cut``.
    """
    bits = (base.count().bit_length() + 1) // 2
    ranged = base.withColumn("_range", F.expr(f"CAST(conv(substr(_key, 1, 8), 16, 10) AS BIGINT) DIV {1 << (32 - bits)}"))
    spans = saved(ranged.groupBy(*_SOURCE, "_range").agg(F.sum("size").alias("_words")), "mix")
    sizes = saved(spans.groupBy(*_SOURCE).agg(F.sum("_words").alias("source_size")), "mix")
    budget = saved(
        targets(sizes, weights, share, most).selectExpr(
            *_SOURCE, "source_size", "target",
            "coalesce(CAST(floor(target) AS BIGINT) DIV nullif(source_size, 0), 0) AS passes",
            "coalesce(CAST(floor(target) AS BIGINT) % nullif(source_size, 0), 0) AS _rest",
        ),
        "mix",
    )
    by = ", ".join(_SOURCE)
    ends = saved(
        spans.selectExpr(*_SOURCE, "_range", "_words", f"sum(_words) OVER (PARTITION BY {by} ORDER BY _range) AS _to")
        .join(budget, _SOURCE)
        .where("_to - _words < _rest AND _rest <= _to")
        .selectExpr(*_SOURCE, "_range", "_rest - (_to - _words) AS _inside"),
        "mix",
    )
    within = "sum(_n * size) OVER (PARTITION BY " + by + " ORDER BY _key, doc_id, size ROWS UNBOUNDED PRECEDING)"
    cuts = (
        ranged.join(broadcast_within(ends), [*_SOURCE, "_range"])
        .groupBy(*_SOURCE, "_inside", "_key", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_to", F.expr(within))
        .where("_to - _n * size < _inside AND _inside <= _to")
        .selectExpr(*_SOURCE, "_key AS _cut", "doc_id AS _cut_id", "size AS _cut_size", "_n", "_inside - (_to - _n * size) AS _words")
    )
    return saved(budget.join(cuts, _SOURCE, "left"), "mix")


def _planned(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the columns of their source's plan; a hot source is split where the plan is too large to be sent."""
    small = broadcast_within(plan)
    return lookup(base, plan, _SOURCE) if small is plan else base.join(small, _SOURCE)


_ABOVE = "_cut IS NULL OR _key > _cut OR (_key = _cut AND NOT (doc_id <=> _cut_id AND size = _cut_size))"
_BELOW = "CASE WHEN _key < _cut THEN 1 ELSE 0 END"
# equal rows at the cut come from the plan, by blocks, as an array of all their numbers might not fit
_BLOCK = 1 << 16


def _copies(plan: DataFrame) -> DataFrame:
    """The equal rows at each cut, numbered from 0 as ``_copy``."""
    return (
        plan.where("_cut IS NOT NULL")
        .withColumn("_block", F.expr(f"explode(sequence(0L, (_n - 1) DIV {_BLOCK}))"))
        .withColumn("_copy", F.expr(f"explode(sequence(_block * {_BLOCK}, least(_n, (_block + 1) * {_BLOCK}) - 1))"))
        .drop("_block")
    )


_PART = "greatest(0L, least(_cut_size, _words - _copy * _cut_size))"  # what a copy takes of the rest


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2,
    seed: str = "mix", id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, passes, taken``.

    ``size`` counts words, and the mix holds ``share`` of all of them, shared by ``targets``. A source's budget is its
    target without the fraction. It is spent in whole passes, then on rows in order of their keys; the last row gives
    its first words only, so that the budget is met exactly. ``taken`` counts the words taken of a row.

    The same rows and seed give the same mix, however they are partitioned. A NULL or empty text has no words and is
    taken with none; a source without words has target 0. A NULL source is a source of its own, the last. Rows equal in
    all three columns have one key and share what is taken of them in turn; rows that share an id but differ in text
    are different rows. A NULL id is like any other. Other columns are ignored; no rows give no rows.
    """
    base = saved(_keyed(docs, seed, id, text, source), "mix")
    plan = _plan(base, weights, share, most)
    named = "CASE WHEN NOT _none THEN _source END AS source"
    rows = _planned(base, plan).where(_ABOVE + " OR _key < _cut").selectExpr(
        "doc_id", named, "size", "source_size", "target", "passes", f"size * (passes + {_BELOW}) AS taken"
    )
    return rows.union(
        _copies(plan).selectExpr(
            "_cut_id AS doc_id", named, "_cut_size AS size", "source_size", "target", "passes",
            f"_cut_size * passes + {_PART} AS taken",
        )
    )


def mixed(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2,
    seed: str = "mix", id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mix itself: ``doc_id, source, epoch, words, text``, one row per use of a row that has words.

    Epochs count from 0. A row cut by its source's budget gives its first words, joined by single spaces. Texts are
    not shuffled; only those at a cut are read once more.
    """
    base = saved(_keyed(docs, seed, id, text, source), "mix")
    plan = _plan(base, weights, share, most)
    texts = _keyed(docs, seed, id, text, source, f"coalesce(`{text}`, '') AS text", f"`{source}` AS source")
    planned = _planned(texts, plan).where("size > 0")
    uses = planned.withColumn("_uses", F.expr(f"passes + {_BELOW}")).where("_uses > 0")
    whole = uses.selectExpr("doc_id", "source", "explode(sequence(0L, _uses - 1)) AS epoch", "size AS words", "text")
    last = planned.where("_key = _cut AND doc_id <=> _cut_id AND size = _cut_size").dropDuplicates(_SOURCE)
    parts = (
        _copies(plan).withColumn("_part", F.expr(_PART)).where("_part > 0").select(*_SOURCE, "_part")
        .join(last.select(*_SOURCE, "doc_id", "source", "passes", "size", "text"), _SOURCE)
    )
    first = f"array_join(slice(regexp_extract_all(text, '{WORD}', 0), 1, CAST(_part AS INT)), ' ')"
    return whole.union(
        parts.selectExpr(
            "doc_id", "source", "passes AS epoch", "_part AS words", f"CASE WHEN _part = size THEN text ELSE {first} END AS text"
        )
    )


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER o AS sizes, sum(weight) OVER o AS weights,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM s WINDOW o AS (ORDER BY source_size * (10 // weight), source NULLS LAST ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT *, weight * (3 * total - 4 * (sizes - source_size)) >= 4 * source_size * (all_weights - weights + weight) AS is_full
  FROM r
), h AS (
  SELECT *, coalesce(sum(source_size) FILTER (is_full) OVER (), 0) AS held,
         coalesce(sum(weight) FILTER (is_full) OVER (), 0) AS gone
  FROM f
), t AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(weight * (3 * total - 4 * held) AS DOUBLE) / CAST(2 * (all_weights - gone) AS DOUBLE) END AS target
  FROM h
), b AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget FROM t
), k AS (
  SELECT doc_id, size, source_size, target, budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM k
"""
