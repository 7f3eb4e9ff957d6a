"""Near-duplicate lines by a segment-partition edit join.

A line of length l is cut into ``t + 1`` segments, where t is the number of edits allowed for its length; a line within
t edits must hold one of them unchanged. Index rows carry the segments of each distinct line, keyed by length, segment
number and content. Probe rows carry the substrings of a line at the few places where a segment of a line up to t
shorter can have moved. Lines that meet on a key are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import broadcast_if_small, components, saved, table
from cutline.llm.shingles import Powers, mix
from cutline.plans.pooled import lookup

# allowed edits by the length of the shorter line, in code points; shorter ones must be equal
EDITS = ((60, 2), (24, 1))
MOST = max(t for _, t in EDITS)
BLOCK = 128  # lines of a hot key that meet in one task, from either side
ROUNDS = 3  # comparisons of each line with the leader of each of its keys
WORTH = 100  # rows per link found up to which another such round is made
FEW = 2  # pairs per row of a key up to which they are joined
CHUNK = 1 << 20  # code points hashed at once
CELLS = 1 << 23  # code points of pairs that are compared together


def _segment(length: np.ndarray, t: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of t + 1; the last ones are longer by one where the length doesn't divide."""
    small, longer = length // (t + 1), length % (t + 1)
    return i * small + np.maximum(0, i - (t + 1 - longer)), small + (i >= t + 1 - longer)


def _keys(lines: list[str], powers: Powers) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Index (side 0) and probe (side 1) keys of some lines: keys, sides and line numbers.

    A segment i that took part in a match with at most t edits in all has moved by at most i places seen from the left,
    and by at most t - i seen from the right. Substrings are hashed by differences of one running sum.
    """
    points = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(x) for x in lines], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(length)))
    up, down = powers.get(len(points) + 1)
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points + np.uint64(1)) * up[: len(points)], out=sums[1:])
    out: tuple[list, list, list] = ([], [], [])

    def add(side: int, rows: np.ndarray, of: np.ndarray, t: int, i: int, move: int) -> None:
        start, size = _segment(of, t, i)
        start = start + move
        fits = (start >= 0) & (start + size <= length[rows])
        rows, of, start, size = rows[fits], of[fits], start[fits] + begin[rows[fits]], size[fits]
        content = mix((sums[start + size] - sums[start]) * down[start])
        out[0].append(mix(content + (of * 64 + t * 8 + i).astype(np.uint64)).view(np.int64))
        out[1].append(np.full(len(rows), side, dtype=np.int32))
        out[2].append(rows)

    ceiling = None
    for floor, t in EDITS:
        allowed = lambda n: (n >= floor) & (n < ceiling if ceiling else True)  # noqa: B023, E731
        for i in range(t + 1):
            rows = np.flatnonzero(allowed(length))
            add(0, rows, length[rows], t, i, 0)
        for shorter in range(t + 1):
            rows = np.flatnonzero(allowed(length - shorter))
            for i in range(t + 1):
                for move in range(max(-i, shorter - (t - i)), min(i, shorter + (t - i)) + 1):
                    add(1, rows, length[rows] - shorter, t, i, move)
        ceiling = floor
    return out


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, line) to (k, side, id)."""
    powers = Powers()
    for batch in batches:
        ids, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        start = held = 0
        for at, line in enumerate(lines):
            held += len(line)
            if held >= CHUNK or at + 1 == len(lines):
                keys, sides, rows = (np.concatenate(x) for x in _keys(lines[start : at + 1], powers))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(sides), pa.array(ids[start : at + 1][rows])], names=["k", "side", "id"]
                )
                start, held = at + 1, 0


def banded_distances(left: list[np.ndarray], right: list[np.ndarray], t: int) -> np.ndarray:
    """Edit distances of pairs of code-point arrays, exact up to ``t`` and ``t + 1`` beyond.

    Bit-parallel columns of the dynamic program, kept to the 2 t + 1 diagonals around the main one; all pairs advance
    together, a column at a time. Bit b of a word is row ``column + b - t``.
    """
    count, band = len(left), 2 * t + 1
    a = np.array([len(x) for x in left], dtype=np.int64)
    b = np.array([len(x) for x in right], dtype=np.int64)
    width = int(max(a.max(initial=0), b.max(initial=0))) + band + 1
    rows = np.full((count, width + 2 * t), -1, dtype=np.int32)
    columns = np.full((count, width), -2, dtype=np.int32)
    for k in range(count):
        rows[k, t : t + a[k]] = left[k]
        columns[k, : b[k]] = right[k]
    one = np.uint64(1)
    full = np.uint64((1 << band) - 1)
    # vertical differences: +1 below the corner, and as if -1 above it, so that row 0 grows by one per column
    up = np.full(count, full & ~np.uint64((1 << t) - 1), dtype=np.uint64)
    down = np.zeros(count, dtype=np.uint64)
    score = np.full(count, t, dtype=np.int64)  # of the lowest row in the band
    result = np.full(count, t + 1, dtype=np.int64)
    alive = np.abs(a - b) <= t
    ends = int(b[alive].max(initial=0))
    for j in range(ends):
        # rows of a column differ by one at most: beyond this score none of the band can come back to t
        if j % 16 == 0 and not (alive & (b > j) & (score <= 3 * t)).any():
            break
        equal = np.zeros(count, dtype=np.uint64)
        sign = columns[:, j]
        for d in range(band):
            equal |= (rows[:, j + d] == sign).astype(np.uint64) << np.uint64(d)
        zero = (((equal & up) + up) ^ up | equal | down) & full
        plus = (down | ~(zero | up)) & full
        minus = zero & up
        # lowest row: one further along the diagonal
        score += 1 - (zero >> np.uint64(band - 1) & one).astype(np.int64)
        moved = zero >> one
        up = (minus | ~(moved | plus)) & full
        down = moved & plus
        finished = np.flatnonzero(alive & (b == j + 1))
        if len(finished):
            # from the lowest row of the band up to the last row of the left line
            low = j + 1 + t - a[finished]
            value = score[finished].copy()
            for k in range(band - 1):
                bit = np.uint64(band - 2 - k)
                step = low > k
                value -= np.where(step, (up[finished] >> bit & one).astype(np.int64) - (down[finished] >> bit & one).astype(np.int64), 0)
            result[finished] = np.minimum(value, t + 1)
    empty = alive & (b == 0)
    result[empty] = np.minimum(a[empty], t + 1)
    return result


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)


def _middles(left: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """What is left of two lines without their common start and end; their edit distance is the same."""
    a, b = _points(left), _points(right)
    shorter = min(len(a), len(b))
    differs = np.flatnonzero(a[:shorter] != b[:shorter])
    start = int(differs[0]) if len(differs) else shorter
    rest = shorter - start
    differs = np.flatnonzero(a[len(a) - rest :] != b[len(b) - rest :])
    end = rest - 1 - int(differs[-1]) if len(differs) else rest
    return a[start : len(a) - end], b[start : len(b) - end]


def within(left: list[str], right: list[str], allowed: np.ndarray) -> np.ndarray:
    """Whether each pair is within its allowed edits; pairs that differ over like lengths are compared together."""
    out = np.zeros(len(left), dtype=bool)
    middles = [_middles(a, b) for a, b in zip(left, right)]
    sizes = np.array([max(len(a), len(b)) for a, b in middles])
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        step = max(16, CELLS // max(int(sizes[some[-1]]), 1))  # bounded memory for very long lines
        for part in (some[k : k + step] for k in range(0, len(some), step)):
            distance = banded_distances([middles[k][0] for k in part], [middles[k][1] for k in part], MOST)
            out[part] = distance <= allowed[part]
    return out


def _limit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shorter = np.minimum(a, b)
    allowed = np.zeros(len(shorter), dtype=np.int64)
    for n, t in sorted(EDITS):
        allowed[shorter >= n] = t
    return allowed


def _verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in frames:
        lengths = [pairs[c].str.len().to_numpy() for c in ("line", "other")]
        good = within(list(pairs["line"]), list(pairs["other"]), _limit(*lengths)) if len(pairs) else []
        yield pairs.loc[good, ["a", "b"]]


def _letter_counts(lines: Iterable[str]) -> np.ndarray:
    """A row per line: how many of its code points leave each remainder by 64."""
    return np.array([np.bincount(_points(line) % 64, minlength=64) for line in lines], dtype=np.int64).reshape(-1, 64)


def _verify_block(block: pd.DataFrame) -> pd.DataFrame:
    """Index lines of a key's block against its probe lines of other components; links that join two of them, no more."""
    index, probe = block[block["side"] == 0], block[block["side"] == 1]
    counts, sizes = _letter_counts(probe["line"]), probe["line"].str.len().to_numpy()
    up = {int(c): int(c) for c in block["comp"]}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    links = []
    for i, comp, line, own in zip(index["id"], index["comp"], index["line"], _letter_counts(index["line"])):
        allowed = _limit(np.full(len(probe), len(line)), sizes)
        # an edit changes the counts by two at most
        close = np.flatnonzero(np.abs(counts - own).sum(axis=1) <= 2 * allowed)
        close = close[[root(int(c)) != root(int(comp)) for c in probe["comp"].iloc[close]]] if len(close) else close
        if not len(close):
            continue
        rest = probe.iloc[close]
        good = within([line] * len(rest), list(rest["line"]), allowed[close])
        for p, other in zip(rest["id"][good], rest["comp"][good]):
            x, y = root(int(comp)), root(int(other))
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((int(i), int(p)))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _meetings(distinct: DataFrame) -> DataFrame:
    """Rows (k, side, id, i, p, n) of the keys on which two different lines meet, with the key's index and probe rows."""
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange serves the counts of each key and the way back to its rows; both only stream over them
    dealt = (
        distinct.where(f"len >= {min(n for n, _ in EDITS)}").select("id", "line")
        .mapInArrow(_key_rows, "k long, side int, id long").repartition(tasks, "k")
    )
    # only keys that two lines share matter; most are one line's own
    busy = (
        dealt.groupBy("k").agg(
            F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.expr("1 - side")).alias("i"), F.sum("side").alias("p")
        )
        .where("low < high AND i > 0").select("k", "i", "p")
    )
    met = saved(dealt.join(busy, "k").select("k", "side", "id", "i", "p"), "met")
    return saved(lookup(met, distinct.select("id", "n"), ["id"]), "met")


def _led(open_: DataFrame, step: int) -> DataFrame:
    """Pairs (a, b) of each line with the leader of each of its keys, if they lie in different components.

    At most one pair per row. The first leader is the line with the most copies, as a family of near-equal lines mostly
    comes from one that is common; later leaders are drawn by hash.
    """
    best = "max(struct(n, -id AS m, id, comp))" if step == 0 else f"max(struct(xxhash64(id, {step}) AS h, -id AS m, id, comp))"
    leaders = open_.groupBy("k").agg(F.expr(f"{best} AS lead"))
    return (
        lookup(open_, leaders, ["k"], "inner").where("comp <> lead.comp")
        .selectExpr("least(id, lead.id) AS a", "greatest(id, lead.id) AS b").distinct()
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return (
        pairs.join(texts.withColumnRenamed("id", "a"), "a")
        .join(texts.selectExpr("id AS b", "line AS other"), "b").select("a", "b", "line", "other")
        # few bytes but much work: not to be gathered into few tasks
        .repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
        .mapInPandas(_verify, "a long, b long")
    )


def _left_open(met: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows (k, side, id, n, comp, i, p) of the keys that still see several components; i and p as in ``_meetings``."""
    known = lookup(met, joined.selectExpr("node AS id", "component"), ["id"]).selectExpr(
        "k", "side", "id", "n", "coalesce(component, id) AS comp"
    )
    several = (
        known.groupBy("k")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum(F.expr("1 - side")).alias("i"), F.sum("side").alias("p"))
        .where("low < high").select("k", "i", "p")
    )
    return saved(lookup(known, several, ["k"], "inner"), "open")


def line_classes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, place, key) of lines that are not blank, and the class of each distinct line (key, cls).

    Lines are joined by edit distance: two lines are linked when it is at most what ``EDITS`` allows for the shorter
    one, and a class is a connected component. A class is named by one of its lines' numbers.

    A family of near-equal lines meets on many keys, and its pairs are the square of its size. Components need no more
    than a spanning set of links. Keys with few lines have all their pairs compared; on the others each line is first
    compared with the leader of each of its keys, at most ``ROUNDS`` times. Only keys that see several components after that
    have their lines compared, and only across components, in blocks that return the links that join some.
    """
    lines = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("place", "line")
    ).where("line RLIKE '[^\\\\s]'").withColumn("key", F.unhex(F.md5("line")))
    # map-side combined: one row per distinct line, whatever the number of its copies
    distinct = saved(
        lines.groupBy("key").agg(F.first("line").alias("line"), F.count(F.lit(1)).alias("n"))
        .select("key", "line", "n", F.char_length("line").alias("len"), F.monotonically_increasing_id().alias("id")),
        "lines",
    )
    sized = _meetings(distinct)
    involved = broadcast_if_small(saved(sized.select("id").distinct(), "involved"))
    texts = saved(distinct.join(involved, "id", "left_semi").select("id", "line"), "involved")
    # keys of which the pairs are about as many as the rows; the others by leaders
    few = f"i * p <= {FEW} * (i + p)"
    easy = sized.where(few)
    pairs = (
        easy.where("side = 0").selectExpr("k", "id AS a").join(easy.where("side = 1").selectExpr("k", "id AS b"), "k")
        .where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    )
    links = saved(_verified(pairs, texts), "line-links")
    joined = components(links, "lines-joined")
    open_ = _left_open(sized.where(f"NOT ({few})"), joined)
    for step in range(ROUNDS):
        rows = open_.count()
        if not rows:
            break
        found = saved(_verified(_led(open_, step), texts), "line-links")
        links = links.union(found)
        joined = components(links, "lines-joined")
        open_ = _left_open(open_.drop("comp"), joined)
        if found.count() * WORTH < rows:
            break  # leaders are no use to what is left
    # what is left: the lines of a key across components, block by block, without a row per pair
    across = (
        lookup(open_, texts, ["id"], "inner")
        .withColumns({"bi": F.expr(f"CAST(ceil(i / {BLOCK}) AS INT)"), "bp": F.expr(f"CAST(ceil(p / {BLOCK}) AS INT)")})
        .where("bi > 0 AND bp > 0")
        .withColumn("own", F.expr("CAST(pmod(xxhash64(id), if(side = 0, bi, bp)) AS INT)"))
        .withColumn("other", F.explode(F.expr("sequence(0, if(side = 0, bp, bi) - 1)")))
        .selectExpr("k", "if(side = 0, own, other) AS x", "if(side = 0, other, own) AS y", "side", "id", "comp", "line")
        .groupBy("k", "x", "y").applyInPandas(_verify_block, "a long, b long")
    )
    if not open_.isEmpty():
        joined = components(links.union(across), "lines-joined")
    classes = distinct.join(joined.withColumnRenamed("node", "id"), "id", "left").selectExpr("key", "coalesce(component, id) AS cls")
    return lines.select("doc_id", "place", "key"), saved(classes, "line-classes")


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line that is not blank with its fate: ``doc_id, place, key, cls, kept``.

    Of a class the first line stays: smallest doc_id, then smallest place. Blank lines are never dropped and not
    listed. NULL and empty texts have no lines. NULL ids come last; repeated rows repeat their lines, and all copies
    of the line that stays are kept.
    """
    occurrences, classes = line_classes(docs, id, text)
    rows = saved(lookup(occurrences, classes, ["key"], "inner"), "occurrences")
    first = rows.groupBy("cls", "doc_id").agg(F.min("place").alias("place")).groupBy("cls").agg(
        F.min(F.struct(F.expr("doc_id IS NULL").alias("n"), "doc_id", "place")).alias("f")
    )
    return lookup(rows, first, ["cls"]).selectExpr(
        "doc_id", "place", "key", "cls", "doc_id <=> f.doc_id AND place = f.place AS kept"
    )


def remove_lines(docs: DataFrame, fates: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their dropped lines; other columns stay."""
    dropped = fates.where("NOT kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("place").alias("_dropped_"))
    joined = docs.join(dropped.withColumnRenamed("doc_id", "_id_"), F.col(id) == F.col("_id_"), "left")
    left = F.expr(
        f"array_join(filter(split({text}, '\\n'), (x, i) -> NOT array_contains(coalesce(_dropped_, array()), i)), '\\n')"
    )
    return joined.withColumn(text, left).select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines that are not blank, those that stay, and the places of those dropped."""
    docs = table(spark, sf_dir, "documents")
    fates = line_dedup(docs)
    per_doc = fates.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.expr("count_if(kept)").alias("n_kept"),
        F.array_sort(F.collect_set(F.expr("CASE WHEN NOT kept THEN place END"))).alias("dropped"),
    )
    return docs.select(F.col("doc_id").cast("long")).join(per_doc, "doc_id", "left").selectExpr(
        "doc_id", "coalesce(n_lines, 0L) AS n_lines", "coalesce(n_kept, 0L) AS n_kept",
        "coalesce(array_join(CAST(dropped AS ARRAY<STRING>), ','), '') AS dropped",
    )
