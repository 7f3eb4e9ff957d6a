"""Sinks: partitioned fact tables and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_facts(facts: DataFrame, path: str, partition: str = "academic_year") -> None:
    """Overwrite only the years that occur in ``facts``; other years stay.

    The hint gathers a year's rows into few files and lets adaptive execution
    split a year that holds most of the rows.
    """
    (
        facts.hint("rebalance", partition)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def read_facts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def document_report(tagged: DataFrame, outcomes: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Per document: candidates, validated and rejected rows, distinct colleges, branches and categories."""
    counts = tagged.groupBy("source_version_id").agg(
        F.expr("sum(size(anomalies)) AS needs_review_records"),
        F.expr("count(DISTINCT college_code) FILTER (WHERE is_valid) AS unique_college_count"),
        F.expr("count(DISTINCT branch_code) FILTER (WHERE is_valid) AS unique_branch_count"),
        F.expr("count(DISTINCT category_code) FILTER (WHERE is_valid) AS category_count"),
    )
    return outcomes.join(counts, "source_version_id", "left").selectExpr(
        "source_version_id", "candidate_records", "extracted_count AS validated_records", "rejected_records",
        "coalesce(needs_review_records, 0L) AS needs_review_records",
        "coalesce(unique_college_count, 0L) AS unique_college_count",
        "coalesce(unique_branch_count, 0L) AS unique_branch_count",
        "coalesce(category_count, 0L) AS category_count",
        "processing_status", *extra,
    )


def run_report(report: DataFrame) -> DataFrame:
    """Counters of a whole run from its document reports."""
    return report.agg(
        F.expr("count(1) AS documents"),
        F.expr("sum(candidate_records) AS records_parsed"),
        F.expr("sum(validated_records) AS records_validated"),
        F.expr("sum(rejected_records) AS records_rejected"),
        F.expr("sum(needs_review_records) AS anomalies"),
        F.expr("count_if(processing_status = 'NEEDS_REVIEW') AS documents_needs_review"),
        F.expr(
            "CASE WHEN count_if(processing_status = 'NEEDS_REVIEW') = 0 THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS status"
        ),
    )
