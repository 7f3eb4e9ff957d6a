"""Monitoring: source freshness, data health, record counts, reconciliation, run history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.ranks import hours_between
from cutline.functions.sql import case
from cutline.plans.pooled import lookup


def source_freshness(sources: DataFrame, versions: DataFrame, reviews: DataFrame, now: str) -> DataFrame:
    """Per source: newest versions, counts, and the first health state that applies.

    Versions and reviews are first reduced to one row per source, so the
    joins are one to one. ``now`` is SQL text.
    """
    seen = versions.groupBy("source_id").agg(
        F.expr("count(1) AS total_versions"),
        F.expr("max_by(source_title, struct(created_at, source_version_id)) AS latest_document_title"),
        F.expr("max(CASE WHEN processing_status = 'PUBLISHED' THEN created_at END) AS latest_published_at"),
    )
    waiting = (
        reviews.filter("status = 'PENDING_REVIEW'")
        .groupBy("source_id")
        .agg(F.expr("count(1) AS pending_review_count"))
    )
    age = hours_between(now, "last_checked_at")
    status = case(
        ("NOT is_enabled", "'DISABLED'"),
        ("last_checked_at IS NULL", "'NEVER_CHECKED'"),
        ("pending_review_count > 0", "'HAS_REVIEW_ITEMS'"),
        (f"{age} > check_frequency_hours * 2", "'STALE'"),
        default="'HEALTHY'",
    )
    joined = sources.join(seen, "source_id", "left").join(waiting, "source_id", "left")
    return joined.selectExpr(
        "source_id",
        "coalesce(source_code, title) AS source_code",
        "is_enabled",
        f"{status} AS status",
        "check_frequency_hours",
        "last_checked_at",
        "latest_document_title",
        "latest_published_at",
        "coalesce(total_versions, 0L) AS total_versions",
        "coalesce(pending_review_count, 0L) AS pending_review_count",
    )


def freshness_summary(freshness: DataFrame) -> DataFrame:
    return freshness.groupBy("status").agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum("total_versions").alias("versions"),
        F.sum("pending_review_count").alias("pending_reviews"),
    )


def _measure(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("measure"), "value")


def data_health(
    colleges: DataFrame,
    branches: DataFrame,
    cutoffs: DataFrame,
    seats: DataFrame,
    fees: DataFrame,
    sources: DataFrame,
    versions: DataFrame,
    errors: DataFrame,
) -> DataFrame:
    """Size and state of the store as (measure, value) rows."""
    rows = F.count(F.lit(1))
    published = F.count_if(F.col("status") == "PUBLISHED")
    parts = [
        _measure(branches, "branch_count", rows),
        _measure(cutoffs, "cutoff_record_count", published),
        _measure(seats, "seat_record_count", published),
        _measure(fees, "fee_record_count", published),
        _measure(sources, "source_count", rows),
        _measure(errors, "warnings_anomalies_count", F.count_if(F.col("severity").isin("WARNING", "ERROR"))),
        _by_value(colleges, "institution_type", "college_count"),
        _by_value(branches.filter("is_canonical"), "program_type", "canonical_branch_count"),
    ]
    states = versions.agg(
        rows.alias("source_version_count"),
        F.count_if(F.col("processing_status").isin("DISCOVERED", "DOWNLOADED", "PARSED")).alias(
            "pending_validation_records"
        ),
        F.count_if(F.col("processing_status") == "REJECTED").alias("rejected_records"),
    )
    parts.append(
        states.select(
            F.inline(
                F.array(
                    *[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in states.columns]
                )
            )
        )
    )
    return reduce(lambda a, b: a.unionByName(b), parts)


def _by_value(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows in all, and by each value of a column."""
    counts = df.rollup(column).agg(F.grouping(column).alias("_all"), F.count(F.lit(1)).alias("value"))
    return counts.select(
        F.when(F.col("_all") == 1, name).otherwise(F.concat_ws(":", F.lit(name), column)).alias("measure"),
        "value",
    )


def recent_runs(runs: DataFrame, limit: int = 5) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(limit)


def latest_good_run(runs: DataFrame) -> DataFrame:
    return recent_runs(runs.filter(F.col("status").isin("SUCCESS", "PARTIAL_SUCCESS")), 1)


def run_history(runs: DataFrame) -> DataFrame:
    return runs.orderBy("started_at", "run_id")


def pending_reviews(reviews: DataFrame, limit: int = 50) -> DataFrame:
    return (
        reviews.filter(F.col("status") == "PENDING_REVIEW")
        .orderBy(F.col("created_at").desc(), "item_id")
        .limit(limit)
    )


def reviews_by_status(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("status").agg(F.count(F.lit(1)).alias("items"))


def records_by_round(facts: DataFrame, rounds: DataFrame) -> DataFrame:
    """Records per round, with the kind of round; records without one are NO_ROUND.

    Facts are counted per stage first; only the counts meet the calendar.
    """
    counts = facts.groupBy("academic_year", "round_code").agg(F.count(F.lit(1)).alias("_n"))
    flags = rounds.select("academic_year", "round_code", "is_general_round")
    general = F.coalesce("is_general_round", F.lit(True))
    return (
        counts.join(flags, ["academic_year", "round_code"], "left")
        .groupBy(
            F.coalesce("round_code", F.lit("NO_ROUND")).alias("round_code"),
            F.when(general, "GENERAL").otherwise("SPECIAL_QUOTA").alias("kind"),
        )
        .agg(F.sum("_n").alias("records"))
    )


def records_by_source(versions: DataFrame, facts: DataFrame, errors: DataFrame) -> DataFrame:
    """Fact and error counts of every source version, 0 where there are none."""
    have = facts.groupBy("source_version_id").agg(F.count(F.lit(1)).alias("_records"))
    wrong = errors.groupBy("source_version_id").agg(F.count(F.lit(1)).alias("_errors"))
    return (
        lookup(lookup(versions, have, ["source_version_id"]), wrong, ["source_version_id"])
        .withColumn("records", F.coalesce("_records", F.lit(0)).cast("long"))
        .withColumn("errors", F.coalesce("_errors", F.lit(0)).cast("long"))
        .drop("_records", "_errors")
    )


def reconcile(counts: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(name, left rows, right rows, MATCH or MISMATCH) for each pair of frames that should agree."""
    parts = []
    for name, left, right in counts:
        sides = left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("l").alias("s"), "n").unionByName(
            right.agg(F.count(F.lit(1)).alias("n")).select(F.lit("r").alias("s"), "n")
        )
        parts.append(
            sides.agg(
                F.max(F.when(F.col("s") == "l", F.col("n"))).alias("left_rows"),
                F.max(F.when(F.col("s") == "r", F.col("n"))).alias("right_rows"),
            ).select(F.lit(name).alias("name"), "left_rows", "right_rows")
        )
    verdict = F.when(F.col("left_rows") == F.col("right_rows"), "MATCH").otherwise("MISMATCH")
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("verdict", verdict)
