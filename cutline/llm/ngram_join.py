"""Jaccard join on word shingles: blocked sparse products of documents by shingles, without a row per pair.

1. Texts become sets of shingles; equal sets form a class with its smallest id as representative.
2. Under the order of hash values a document keeps the smallest ``|x| - ceil(0.8 |x|) + l(x)`` shingles, with
   ``l(x) = 1 + |x| // SPARE``. Two linked documents share at least ``min(l(x), l(y))`` of those, so a document that
   shares fewer with all others together is done. Of the shared ones it then needs only the rarest ``shared - l + 1``.
3. Each document is compared with the one that leads most of its shingles (one pair a document). Shingles that are
   left with one component only are done; for a group of copies of any size, that is all of them.
4. What still has several components is cut into blocks of bounded size, within clusters of documents that may link.
   A task multiplies the incidence matrices of two blocks, accumulates overlap counts, discards those below the bound
   set by both sizes, and returns the links that join components: fewer rows than documents, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import broadcast_if_small, components, saved, short_batches, table
from cutline.llm.shingles import Powers, batch_shingles
from cutline.plans.pooled import lookup

WIDTH = 5
PERCENT = 80  # links need 100 * intersection >= PERCENT * union
SPARE = 10
BLOCK = 1 << 20  # shingles in a block


def needed(n):
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-PERCENT * n // 100)


def prefix(shingles: np.ndarray) -> np.ndarray:
    n = len(shingles)
    return shingles[: n - needed(n) + 1 + n // SPARE] if n else shingles


# overlap within the prefixes of a document of n shingles and the smallest partner it can have
_SHARE = f"(1 + ({PERCENT} * n + 99) DIV 100 DIV {SPARE})"


def _as_list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def shingle_sets(docs: DataFrame, whole: bool, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, signature of the set, and its prefix (or the whole set) as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = list(batch_shingles(part.column(1).to_pylist(), WIDTH, powers))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.md5(s.tobytes()).hexdigest() for s in sets]),
                        _as_list(sets if whole else [prefix(s) for s in sets]),
                    ],
                    names=["doc_id", "n", "signature", "shingles"],
                )

    return docs.select(F.col(id).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, n long, signature string, shingles array<long>"
    )


class _Forest:
    def __init__(self, size: int) -> None:
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def block_product(sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between documents of different groups, as few as join those groups.

    ``sides`` 0 and 1: only pairs across the two sides are looked at. Rows of the product are made one document at a
    time: counts of the shingles shared with each later document.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    labels, group = np.unique(groups, return_inverse=True)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    column = np.unique(np.concatenate(sets) if len(sets) else np.empty(0), return_inverse=True)[1].ravel()
    order = np.argsort(column, kind="stable")
    held = owner[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(column))))
    place = np.empty(len(order), dtype=np.int64)  # of each entry within its column's documents
    place[order] = np.arange(len(order))
    last = bounds[column + 1]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    forest, links = _Forest(len(labels)), []
    for i in range(len(sets)):
        own = slice(starts[i], starts[i + 1])
        first, count = place[own] + 1, last[own] - place[own] - 1
        total = int(count.sum())
        if not total:
            continue
        steps = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        overlap = np.bincount(held[steps], minlength=len(sets))
        other = np.flatnonzero(overlap)
        both = overlap[other]
        linked = other[100 * both >= PERCENT * (sizes[i] + sizes[other] - both)]
        for j in linked:
            if (sides is None or sides[i] != sides[j]) and forest.join(int(group[i]), int(group[j])):
                links.append((int(labels[group[i]]), int(labels[group[j]])))
    return links


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, low, high, side, comp, shingles) sorted by block pair: multiply each, small clusters together."""
    key, sets, groups, sides, held = None, [], [], [], 0
    names = ["a", "b"]

    def done():
        links = block_product(sets, np.array(groups, np.int64), np.array(sides) if key[1] != key[2] else None)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links) if links else ([], []))], names=names)

    for batch in batches:
        values = batch.column(5).flatten().to_numpy()
        ends = np.cumsum(np.concatenate(([0], batch.column(5).value_lengths().to_numpy())))
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for r, (cluster, low, high, side, comp) in enumerate(zip(*columns)):
            now = (cluster, low, high)
            if key is not None and now != key and (held > BLOCK // 4 or low != high or key[1] != key[2]):
                yield done()
                sets, groups, sides, held = [], [], [], 0
            key = now
            sets.append(values[ends[r] : ends[r + 1]].copy())
            groups.append(comp)
            sides.append(side)
            held += len(sets[-1])
    if key is not None:
        yield done()


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, and ``signature`` of its set.

    Repeated rows give repeated rows. A NULL, empty or blank text has no shingle and stays alone. A NULL id takes part
    in nothing and gets a NULL component. Very long texts are hashed whole; no rows give no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    sets = saved(shingle_sets(docs, False, id, text), "shingles")
    real = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = saved(real.groupBy("signature", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # a class's prefix comes from the row that represents it
    postings = (
        real.join(broadcast_if_small(classes.select(F.col("rep").alias("doc_id"), "signature")), ["doc_id", "signature"])
        .dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n", F.explode("shingles").alias("h"))
        if _repeats(real)
        else real.join(broadcast_if_small(classes.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("rep"), "n", F.explode("shingles").alias("h"))
    )
    often = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = lookup(postings, often, ["h"], "inner")
    rank = "row_number() OVER (PARTITION BY rep ORDER BY df, h)"
    keys = saved(
        shared.selectExpr("rep", "n", "h", f"{rank} AS r", "count(1) OVER (PARTITION BY rep) AS s")
        .where(f"s >= {_SHARE} AND r <= s - {_SHARE} + 1").select("rep", "h"),
        "keys",
    )
    # whole sets of those that are left
    left = saved(keys.select("rep").distinct(), "left")
    full = saved(
        shingle_sets(
            docs.join(broadcast_if_small(left.select(F.col("rep").alias(id))), id, "left_semi").select(id, text),
            True, id, text,
        ).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n", "shingles"),
        "full",
    )
    # one comparison per document: with the leader of most of its shingles
    leaders = keys.groupBy("h").agg(F.min("rep").alias("lead"))
    pairs = (
        lookup(keys, leaders, ["h"], "inner").where("lead <> rep")
        .groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("rep").agg(F.expr("max_by(lead, c)").alias("lead"))
    )
    first = (
        pairs.join(full, "rep")
        .join(full.select(F.col("rep").alias("lead"), F.col("n").alias("m"), F.col("shingles").alias("other")), "lead")
        .selectExpr("rep AS a", "lead AS b", "n + m AS total", "size(array_intersect(shingles, other)) AS both")
        .where(f"100 * both >= {PERCENT} * (total - both)")
    )
    labels = components(first, "links")
    nodes = saved(
        left.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .selectExpr("rep", "coalesce(component, rep) AS comp"),
        "nodes",
    )
    # shingles that still see several components
    open_ = keys.join(nodes, "rep")
    mixed = open_.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    meets = saved(lookup(open_, mixed, ["h"], "inner").select("rep", "comp", "low").distinct(), "mixed")
    clusters = components(meets.selectExpr("comp AS a", "low AS b"), "clusters")
    members = (
        meets.select("rep", "comp").distinct()
        .join(clusters.withColumnRenamed("node", "comp").withColumnRenamed("component", "cluster"), "comp")
        .join(full, "rep")
    )
    members = saved(members.select("cluster", "rep", "comp", "n", "shingles"), "members")
    counts = members.groupBy("cluster").agg(F.expr(f"CAST(ceil(sum(n) / {BLOCK}) AS INT) AS blocks"))
    dealt = (
        lookup(members, counts, ["cluster"], "inner")
        .withColumn("own", F.expr("CAST(pmod(xxhash64(rep), blocks) AS INT)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .selectExpr("cluster", "least(own, other) AS low", "greatest(own, other) AS high",
                    "CAST(own > other AS INT) AS side", "comp", "shingles")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = (
        dealt.repartition(tasks, "cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
        .mapInArrow(_blocks, "a long, b long")
    )
    joined = components(last, "joined")
    final = (
        nodes.join(joined.withColumnRenamed("node", "comp"), "comp", "left")
        .selectExpr("rep", "coalesce(component, comp) AS component_id")
    )
    by_class = saved(
        classes.join(final, "rep", "left").selectExpr("signature", "n", "coalesce(component_id, rep) AS component_id"),
        "final",
    )
    return lookup(sets, by_class, ["signature", "n"]).selectExpr(
        "doc_id", "n AS n_shingles", "coalesce(CASE WHEN doc_id IS NOT NULL THEN component_id END, doc_id) AS component_id",
        "signature",
    )


def _repeats(rows: DataFrame) -> bool:
    """Whether an id occurs twice."""
    return not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest id.

    Rows without an id, and rows that share an id with another row, stay: the join tells documents apart by their ids.
    """
    found = jaccard_components(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.expr("component_id <> doc_id")).alias("copy")
    )
    dropped = found.where("rows = 1 AND copy").select("doc_id")
    return docs.join(broadcast_if_small(saved(dropped, "dropped")), "doc_id", "left_anti").select(*docs.columns)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).drop("signature")
