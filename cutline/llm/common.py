"""Helpers shared by the operators: tables, written intermediate results, checked broadcasts, components."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.plans.pooled import broadcast_within  # noqa: F401
from cutline.sources.workdir import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session send at most ``rows`` rows at once to Python; an executor and its workers hold whole batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, min(now, rows) if now > 0 else rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """As ``short_batches``, for the jobs that run inside the block; the session's own setting is then put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    short_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """Broadcast a narrow table of at most ``rows`` rows; leave a larger one to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """Connected components of edges (a, b): a row (node, component) per node of an edge, with the smallest node.

    Each round sends every node to its smallest neighbour, follows that one step further, and contracts the edges;
    at least half of the nodes vanish per round. A hot node only gets combined minima. Rounds are written down, and
    only the emptiness of the edges reaches the driver.
    """
    edges = saved(edges.selectExpr("a", "b").where("a <> b").distinct(), purpose)
    rounds = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.selectExpr("b", "a"))
        near = saved(both.groupBy("a").agg(F.expr("least(a, min(b)) AS p")).select("a", "p"), purpose)
        near = saved(
            near.join(near.selectExpr("a AS p", "p AS q"), "p").select("a", F.col("q").alias("p")), purpose
        )
        rounds.append(near)
        edges = saved(
            edges.join(near, "a").select("b", F.col("p").alias("_a"))
            .join(near.selectExpr("a AS b", "p AS _b"), "b")
            .where("_a <> _b").selectExpr("_a AS a", "_b AS b").distinct(),
            purpose,
        )
    if not rounds:
        return edges.selectExpr("a AS node", "b AS component")
    out = rounds[0].selectExpr("a AS node", "p AS _c")
    for near in rounds[1:]:
        out = out.join(near.selectExpr("a AS _c", "p"), "_c", "left").selectExpr("node", "coalesce(p, _c) AS _c")
    return saved(out.withColumnRenamed("_c", "component"), purpose)
