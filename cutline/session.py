"""Session settings the engine is written for."""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # call sites of column operators are for debugging and cost driver time
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app: str = "cutline") -> SparkSession.Builder:
    """A session builder with the settings above; add the master and sizes of the cluster."""
    out = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]):
    """Settings for the jobs that run inside the block; the session's own are then put back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def smaller_partitions(spark: SparkSession, times: int = 4, most: int = 16 << 20) -> dict[str, str]:
    """Settings by which shuffles start from more partitions and end in ones of at most ``most`` bytes.

    Sorts of wide rows then fit in memory, where they would be spilled to disk. Adaptive execution joins partitions of
    small shuffles as before; without it nothing changes.
    """
    first, target = (f"spark.sql.adaptive.{x}" for x in ("coalescePartitions.initialPartitionNum", "advisoryPartitionSizeInBytes"))
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(target))
    partitions = max(int(spark.conf.get(first, None) or 0), times * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return {first: str(partitions), target: str(min(held, most))}
