"""Seeded dimensions and the registry of official sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.sql import case, columns, text
from cutline.plans.calendar import RoundCalendar

# The categories every store starts with
CATEGORIES = [
    ("GM", "General Merit", "Unreserved Karnataka and non-Karnataka open quota"),
    ("KKR", "Kalyana Karnataka Region", "Hyderabad-Karnataka quota under Article 371J"),
    ("HKR", "Hyderabad Karnataka Region", "Legacy Hyderabad-Karnataka reservation quota"),
]

CONFIG_FIELDS = ["title", "authority_level", "is_enabled", "check_frequency_hours", "document_type", "parser_version"]


def seed_categories(spark: SparkSession, existing: DataFrame) -> DataFrame:
    """Existing categories, and the standard ones that are absent."""
    rows = ", ".join(f"({text(a)}, {text(b)}, {text(c)})" for a, b, c in CATEGORIES)
    seeds = spark.sql(f"SELECT * FROM VALUES {rows} AS c(category_code, category_name, description)")
    return existing.unionByName(seeds.join(existing, "category_code", "left_anti"))


def seed_rounds(existing: DataFrame, calendar: RoundCalendar) -> DataFrame:
    """Existing rounds with their general flag put right, and the calendar's rounds that are absent."""
    seeds = calendar.rounds_frame(existing.sparkSession).select(
        "academic_year", "round_code", "round_name", "round_number", "is_general_round"
    )
    key = ["academic_year", "round_code"]
    flags = seeds.selectExpr(*key, "is_general_round AS _flag")
    corrected = (
        existing.join(flags, key, "left")
        .withColumn("is_general_round", F.expr("coalesce(_flag, is_general_round)"))
        .drop("_flag")
    )
    return corrected.unionByName(seeds.join(existing, key, "left_anti"))


def sync_sources(existing: DataFrame, configured: DataFrame) -> DataFrame:
    """Existing sources with their configuration renewed, and configured sources that are absent.

    A source is known by its code or by its address; a match by code goes
    first. Fields that the running system writes stay as they are.
    """
    config = configured.selectExpr(
        "source_code AS _code", "url AS _url", *[f"{c} AS _{c}" for c in CONFIG_FIELDS]
    )
    by_code = existing.selectExpr("source_id AS _by_code", "source_code AS _c")
    by_url = existing.groupBy("url").agg(F.expr("min(source_id) AS _by_url")).withColumnRenamed("url", "_u")
    matched = (
        config.join(by_code, F.expr("_code = _c"), "left")
        .join(by_url, F.expr("_url = _u"), "left")
        .withColumn("_id", F.expr("coalesce(_by_code, _by_url)"))
        .drop("_c", "_u", "_by_code", "_by_url")
    )
    # two settings may meet in one source; the later code wins
    per_source = matched.filter("_id IS NOT NULL").groupBy("_id").agg(
        F.expr(f"max_by(struct(_code, {', '.join('_' + c for c in CONFIG_FIELDS)}), _code) AS _s")
    )
    renewed = (
        existing.join(per_source, F.expr("source_id = _id"), "left")
        .withColumns(
            columns(
                {
                    "outcome": case(("_id IS NULL", "'KEPT'"), default="'UPDATED'"),
                    "source_code": "CASE WHEN _id IS NULL THEN source_code ELSE _s._code END",
                    **{c: f"CASE WHEN _id IS NULL THEN {c} ELSE _s._{c} END" for c in CONFIG_FIELDS},
                }
            )
        )
        .drop("_id", "_s")
    )
    absent = matched.filter("_id IS NULL").selectExpr(
        "sha2(concat_ws('|', _code, _url), 256) AS source_id", "_code AS source_code", "_url AS url",
        *[f"_{c} AS {c}" for c in CONFIG_FIELDS], "'INSERTED' AS outcome",
    )
    return renewed.unionByName(absent, allowMissingColumns=True)
