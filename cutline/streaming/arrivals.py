"""Streaming count of arrivals: distinct documents and copies per source and day, late ones included.

Each trigger writes counts of its own rows per (day, source, fingerprint); a day's counts are the sum of what the
triggers wrote. There is no state to expire, so a row counts whenever it comes. Rows behind the watermark, the newest
time of earlier triggers less a delay, are counted apart as late. A day touched by many triggers is merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.sql import text
from cutline.sources.store import Staged, Store

COUNTS = (
    "source_id string, content_hash string, copies bigint, first_seen timestamp, last_seen timestamp, late bigint, day string"
)
MERGE_FROM = 8  # so many pieces of a day become one


def arrival_counts(arrivals: DataFrame, watermark: str | None = None) -> DataFrame:
    """Copies per (day, source, fingerprint) of rows (source_id, ts, content), and how many lie behind the watermark.

    The group combines on the map side, so a document that arrives a billion times costs one row per task. Rows without
    a time form a day of their own, NULL.
    """
    late = "false" if watermark is None else f"ts < CAST({text(watermark)} AS TIMESTAMP)"
    return (
        arrivals.selectExpr("source_id", "CAST(ts AS TIMESTAMP) AS ts", "date_format(ts, 'yyyy-MM-dd') AS day", "content")
        .groupBy("day", "source_id", F.sha2("content", 256).alias("content_hash"))
        .agg(
            F.expr("count(1) AS copies"), F.expr("min(ts) AS first_seen"), F.expr("max(ts) AS last_seen"),
            F.expr(f"count_if({late}) AS late"),
        )
    )


def _merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("day", "source_id", "content_hash").agg(
        F.expr("sum(copies) AS copies"), F.expr("min(first_seen) AS first_seen"), F.expr("max(last_seen) AS last_seen"),
        F.expr("sum(late) AS late"),
    )


def count_batch(store: Store, arrivals: DataFrame, batch_id: int, delay: str = "7 days") -> None:
    """Add one batch. A batch that was committed before is skipped."""
    before = store.snapshot()
    if before.done(batch_id):
        return
    newest = before.notes.get("newest")
    edge = None if newest is None else arrivals.sparkSession.sql(
        f"SELECT CAST(TIMESTAMP{text(newest)} - INTERVAL {delay} AS STRING)"
    ).first()[0]
    added = store.stage(arrival_counts(arrivals, edge), "arrivals", ["day"])
    latest = store.staged(added).agg(F.expr("CAST(max(last_seen) AS STRING)")).first()[0]
    full = [p for p in added.parts if len(before.tables.get("arrivals", {}).get(p, [])) + 1 >= MERGE_FROM]
    notes = {} if latest is None else {"newest": max(latest, newest or latest)}
    if not full:
        store.commit(before, batch_id, append=[added], notes=notes)
        return
    merged = store.stage(_merged(store.read(before, "arrivals", COUNTS, full, also=added)), "arrivals", ["day"])
    rest = Staged(added.table, added.commit, tuple(p for p in added.parts if p not in full), added.schema)
    store.commit(before, batch_id, replace=[(merged, full)], append=[rest], notes=notes)


def run_arrivals(arrivals: DataFrame, path: str, checkpoint: str, delay: str = "7 days") -> None:
    """Process everything that is there and stop."""
    store = Store(arrivals.sparkSession, path)
    query = (
        arrivals.writeStream.foreachBatch(lambda batch, batch_id: count_batch(store, batch, batch_id, delay))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _counts(spark: SparkSession, path: str) -> DataFrame:
    store = Store(spark, path)
    return _merged(store.read(store.snapshot(), "arrivals", COUNTS))


def daily_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Per source and day: distinct documents, all arrivals, and those that were copies."""
    return _counts(spark, path).groupBy("source_id", "day").agg(
        F.expr("count(1) AS documents"), F.expr("sum(copies) AS arrivals"), F.expr("sum(copies) - count(1) AS copies")
    )


def late_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Per source and day: arrivals that lay behind the watermark of their trigger. They are counted above as well."""
    return _counts(spark, path).groupBy("source_id", "day").agg(F.expr("sum(late) AS late")).where("late > 0")


def staleness(daily: DataFrame, now: str, hours: int) -> DataFrame:
    """Per source the last day with an arrival, and whether that is longer ago than twice the hours."""
    last = daily.groupBy("source_id").agg(F.expr("max(day) AS last_day"), F.expr("sum(arrivals) AS arrivals"))
    days = f"datediff(DATE'{now}', CAST(last_day AS DATE))"
    return last.withColumn("status", F.expr(f"CASE WHEN {days} * 24 > {2 * hours} THEN 'STALE' ELSE 'HEALTHY' END"))
