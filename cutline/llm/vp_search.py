"""Nearest neighbours by vantage-point trees, one per shard.

On unit vectors the Euclidean distance is a metric and falls as the cosine grows, so the triangle inequality prunes: a
side of a node is left out if no point there can be nearer than the k-th found so far. ``factor`` relaxes this: the
k-th distance is divided by it, so that factor 1 is exact search and larger factors skip more.

Every query visits the tree of every shard; shards are of fixed size, and queries stream through a shard's task in
batches, so memory does not grow with either table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm.common import saved, table

SHARD = 8192
LEAF = 128
TOLERANCE = 1e-7  # rounding of distances; keeps ties in reach


class VantageTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.unit = vectors / self.norms[:, None]
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray):
        """A leaf of rows, or (vantage, inner radius bounds, inner side, outer bounds, outer side).

        Sides have equal sizes, whatever the ties, so identical vectors make no deep tree.
        """
        if len(rows) <= LEAF:
            return rows
        vantage = self.unit[rows[len(rows) // 2]]
        far = np.sqrt(np.maximum(2 - 2 * (self.unit[rows] @ vantage), 0))
        order = np.argsort(far, kind="stable")
        rows, far = rows[order], far[order]
        half = len(rows) // 2
        return (
            vantage, (far[0], far[half - 1]), self._grow(rows[:half]), (far[half], far[-1]), self._grow(rows[half:]),
        )

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int, factor: float):
        """Row, id and cosine of the ``k`` nearest of each query, without the query's own id; unfilled ones are -inf."""
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        unit = vectors / norms[:, None]
        best = np.full((len(ids), k), -np.inf)
        names = np.full((len(ids), k), np.iinfo(np.int64).max)

        def visit(node, queries: np.ndarray) -> None:
            if not len(queries):
                return
            if isinstance(node, np.ndarray):
                dots = np.einsum("qd,rd->qr", vectors[queries], self.vectors[node])
                scores = dots / (norms[queries][:, None] * self.norms[node])
                scores[ids[queries][:, None] == self.ids[node]] = -np.inf
                scores = np.concatenate([best[queries], scores], axis=1)
                own = np.concatenate([names[queries], np.broadcast_to(self.ids[node], (len(queries), len(node)))], axis=1)
                order = np.lexsort((own, -scores), axis=1)[:, :k]
                best[queries] = np.take_along_axis(scores, order, axis=1)
                names[queries] = np.take_along_axis(own, order, axis=1)
                return
            vantage, inner, inside, outer, outside = node
            far = np.sqrt(np.maximum(2 - 2 * (unit[queries] @ vantage), 0))
            near = far <= (inner[1] + outer[0]) / 2
            for first, second, own in (
                ((inner, inside), (outer, outside), near), ((outer, outside), (inner, inside), ~near)
            ):
                group, distance = queries[own], far[own]
                for bounds, side in (first, second):
                    reach = np.sqrt(np.maximum(2 - 2 * best[group, -1], 0)) / factor + TOLERANCE
                    gap = np.maximum(bounds[0] - distance, distance - bounds[1])
                    visit(side, group[gap <= reach])

        visit(self.root, np.arange(len(ids)))
        return best, names


def _search_shards(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (dim, shard, is_query, vec_id, embedding): of each shard first its candidates, then the queries."""
        key, tree, ids, vectors = None, None, [], []
        for batch in batches:
            names = batch.column(3).to_numpy()
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum([0, *batch.column(4).value_lengths().to_pylist()])
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                dim, shard, query = keys[lo]
                rows = flat[ends[lo] : ends[hi]].reshape(hi - lo, dim)
                if (dim, shard) != key:
                    key, tree, ids, vectors = (dim, shard), None, [], []
                if not query:
                    ids.append(names[lo:hi])
                    vectors.append(rows)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = VantageTree(np.concatenate(ids), np.concatenate(vectors))
                for at in range(0, hi - lo, 512):
                    some = slice(at, min(at + 512, hi - lo))
                    best, found = tree.search(names[lo:hi][some], rows[some], k, factor)
                    q, r = np.nonzero(np.isfinite(best))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[lo:hi][some][q]), pa.array(found[q, r]), pa.array(best[q, r])],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def nearest(
    vectors: DataFrame, query: str, k: int = 5, factor: float = 1.0, shard: int = SHARD,
    id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by cosine of each row for which ``query`` (SQL) holds.

    NULL or zero vectors, those with NULL or non-finite components and NULL ids take no part. Vectors meet only those
    of the same length. Of rows that repeat an id the smallest vector counts. Ties go to the smaller id. All rows are
    candidates but the query's own; with fewer than ``k``, all are returned; without rows, none.
    """
    spark = vectors.sparkSession
    clean = saved(
        vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e"))
        .where("vec_id IS NOT NULL AND e IS NOT NULL")
        .where("NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
        .where("aggregate(e, 0D, (a, x) -> a + x * x) > 0")
        .groupBy("vec_id").agg(F.min("e").alias("e"))
        .withColumn("dim", F.size("e")),
        "vectors",
    )
    shards = {r["dim"]: -(-r["n"] // shard) for r in clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = F.expr("CASE dim " + " ".join(f"WHEN {d} THEN {n}" for d, n in shards.items()) + " END") if shards else F.lit(1)
    rows = clean.select("dim", F.expr("vec_id"), "e", count.alias("shards"))
    candidates = rows.selectExpr("dim", "CAST(pmod(xxhash64(vec_id), shards) AS INT) AS shard", "false AS q", "vec_id", "e")
    queries = rows.where(query).selectExpr("dim", "explode(sequence(0, CAST(shards AS INT) - 1)) AS shard", "true AS q", "vec_id", "e")
    tasks = max(sum(shards.values()), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = (
        candidates.union(queries).repartition(tasks, "dim", "shard").sortWithinPartitions("dim", "shard", "q", "vec_id")
        .mapInArrow(_search_shards(k, factor), "query_id long, vec_id long, score double")
    )
    return (
        found.selectExpr(
            "query_id", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank",
            "vec_id", "score",
        ).where(F.col("rank") <= k)
    )


def op4_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
