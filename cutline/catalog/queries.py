"""Registered queries: each takes a session and a table directory and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.catalog.oracle import YOY_PAIRS
from cutline.functions.ranks import in_lakhs, rounded, signed_thousands
from cutline.functions.ranks import thousands as rank_text
from cutline.operators import backtest as bt
from cutline.operators import longitudinal as lon
from cutline.operators import lookups as look
from cutline.operators import monitor as mon
from cutline.operators import predict as pre
from cutline.operators import publish as pub
from cutline.operators import quality as dq
from cutline.plans.history import as_of
from cutline.plans.panel import terminal_states
from cutline.functions import text as tx
from cutline.sources import grids, pages, registry, sinks
from cutline.sources.star import BASE_YEAR, YEARS, Star
from cutline.sources.workdir import shared_folder
from cutline.streaming import arrivals as arrivals_stream
from cutline.streaming.ingest import CutoffIngest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def register(fn: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Star(spark, sf_dir))
    return fn


def round_columns(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.expr(rounded(c, digits)) for c in columns})


def join_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.expr(f"array_join(CAST({c} AS ARRAY<STRING>), ',')") for c in columns})


# longitudinal ---------------------------------------------------------------

_MEANS = ["mean_absolute_movement", "mean_relative_movement", "median_relative_movement"]


@register
def panel(s: Star) -> DataFrame:
    return s.panel()


@register
def yoy_items(s: Star) -> DataFrame:
    return round_columns(lon.yoy_items(s.wide(), YOY_PAIRS), ["relative_movement"])


@register
def yoy_aggregate(s: Star) -> DataFrame:
    return round_columns(lon.yoy_aggregate(lon.yoy_items(s.wide(), YOY_PAIRS)), _MEANS)


@register
def yoy_terminal(s: Star) -> DataFrame:
    return round_columns(lon.yoy_aggregate(lon.yoy_items(s.wide(), YOY_PAIRS, "TERMINAL")), _MEANS)


@register
def comparability(s: Star) -> DataFrame:
    """Every ordered pair of observed (year, round) stages; as many stages as the calendar has."""
    stages = s.panel(status=None).select("academic_year", "round_code").distinct()
    slots = ", ".join(f"named_struct('year2', {y}, 'round2', '{r}')" for y, r in s.calendar.slots)
    pairs = (
        stages.toDF("year1", "round1")
        .selectExpr("year1", "round1", f"inline(array({slots}))")
        .filter("year1 < year2")
        .join(stages.toDF("year2", "round2"), ["year2", "round2"], "left_semi")
    )
    status = s.calendar.comparability(*[F.col(c) for c in ("year1", "round1", "year2", "round2")])
    return pairs.withColumn("comparability", status)


@register
def coverage_counts(s: Star) -> DataFrame:
    return lon.coverage_counts(s.panel(status=None))


@register
def coverage_entities(s: Star) -> DataFrame:
    return lon.coverage_entities(s.panel())


@register
def coverage_depth(s: Star) -> DataFrame:
    return lon.observation_depth(s.panel())


@register
def year_patterns(s: Star) -> DataFrame:
    return lon.year_patterns(s.panel())


@register
def excluded_records(s: Star) -> DataFrame:
    return lon.excluded_records(s.cutoffs(), s.colleges(), s.branches()).drop("exclusion_reason")


@register
def terminal_state(s: Star) -> DataFrame:
    return terminal_states(s.wide())


def _volatility(s: Star, scope: str) -> DataFrame:
    out = lon.volatility_metrics(s.wide(), scope).drop("sequential_relative_movements")
    out = round_columns(out, ["mean", "standard_deviation", "coefficient_of_variation"])
    return join_arrays(out, ["years_observed", "missing_years", "sequential_absolute_movements"])


@register
def volatility(s: Star) -> DataFrame:
    return _volatility(s, "TERMINAL")


@register
def volatility_strict(s: Star) -> DataFrame:
    return _volatility(s, "STRICT_TERMINAL")


@register
def volatility_r1(s: Star) -> DataFrame:
    return _volatility(s, "R1")


@register
def volatility_by_n(s: Star) -> DataFrame:
    return round_columns(
        lon.volatility_by_n(s.wide()), ["mean_cv", "min_cv", "max_cv", "median_cv", "median_relative_movement"]
    )


@register
def progression(s: Star) -> DataFrame:
    return round_columns(lon.round_progression(s.wide()), _MEANS)


@register
def recency(s: Star) -> DataFrame:
    return round_columns(
        lon.recency_evidence(s.wide(), 2001),
        ["recent_median_relative_distance", "older_median_relative_distance", "recent_closer_percentage"],
    )


@register
def sparsity(s: Star) -> DataFrame:
    return join_arrays(lon.sparsity(s.panel(), s.calendar), ["years_observed", "missing_years"])


@register
def anomalies(s: Star) -> DataFrame:
    return lon.anomalies(s.panel(), s.wide()).drop("cause", "description")


@register
def progression_matrix(s: Star) -> DataFrame:
    return lon.progression_matrix(s.wide())


@register
def round_ladder(s: Star) -> DataFrame:
    return lon.round_ladder(s.wide())


@register
def highest_round(s: Star) -> DataFrame:
    return lon.highest_round(s.wide())


@register
def college_boundary(s: Star) -> DataFrame:
    ranks = s.cutoffs().groupBy("college_id").agg(F.floor(F.avg("opening_rank")).cast("int").alias("candidate_rank"))
    return lon.college_boundary(s.panel(), ranks)


# lookups --------------------------------------------------------------------


@register
def cutoff_page(s: Star) -> DataFrame:
    found = look.find_cutoffs(s.cutoffs(), s.colleges(), s.branches(), s.rounds(), category="GM")
    return look.page(found, [F.col("closing_rank"), F.col("record_id")], 50, 100)


@register
def cutoff_total(s: Star) -> DataFrame:
    return look.total(look.find_cutoffs(s.cutoffs(), s.colleges(), s.branches(), s.rounds()))


@register
def seat_page(s: Star) -> DataFrame:
    found = look.find_seats(s.seats(), s.colleges(), s.branches(), s.rounds())
    found = found.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))
    return look.page(found, [F.col("created_at").desc(), F.col("record_id")], 50, 50).drop("category_code")


@register
def fee_page(s: Star) -> DataFrame:
    found = look.find_fees(s.fees(), s.colleges(), s.branches())
    top = look.page(found, [F.col("total_fee").desc(), F.col("record_id")], 50, 20)
    return top.withColumns({c: F.col(c).cast("double") for c in ("total_fee", "tuition_fee", "other_fee")})


@register
def college_search(s: Star) -> DataFrame:
    return look.search_colleges(s.colleges(), query="nation_1", institution_type="ALL")


@register
def branch_search(s: Star) -> DataFrame:
    return look.search_branches(s.branches(), query="m", program_type="ALL", canonical=None)


@register
def college_detail(s: Star) -> DataFrame:
    return look.college_details(s.colleges(), s.aliases())


@register
def source_catalogue(s: Star) -> DataFrame:
    return look.source_catalogue(s.sources(), s.versions()).drop("last_checked_at", "version_created_at")


@register
def entity_resolve(s: Star) -> DataFrame:
    """Look up suppliers by what customers' names end in, by code, and by part of a name."""
    customer = s.table("customer")
    terms = customer.select(
        F.explode(
            F.array(
                F.col("c_custkey").cast("string"),
                F.format_string("s%05d", "c_custkey"),
                F.substring_index("c_name", "#", -1),
            )
        ).alias("term")
    ).distinct()
    entities = s.colleges().select(
        F.col("college_id").alias("entity_id"), F.col("college_code").alias("code"),
        F.col("original_name").alias("short_name"),
    )
    return look.resolve_entities(terms, entities)


@register
def compare(s: Star) -> DataFrame:
    chosen = s.colleges().select("college_id", "college_code")
    out = look.compare_colleges(chosen, s.cutoffs(), s.fees(), s.colleges(), s.branches(), s.rounds())
    return out.withColumn("annual_fee", F.col("annual_fee").cast("double"))


@register
def rank_containment(s: Star) -> DataFrame:
    """Each published cutoff against a rank taken from its own college's cutoffs."""
    kept = s.panel().select("record_id", "college_id", "closing_rank", "opening_rank")
    return look.rank_containment(kept, "opening_rank * 2")


@register
def top_closing_ranks(s: Star) -> DataFrame:
    return look.most_frequent(s.cutoffs(), "closing_rank")


@register
def custom_order(s: Star) -> DataFrame:
    """First rows by a position list of rounds, final round first."""
    kept = s.cutoffs().select("record_id", "round_code", "closing_rank")
    return look.in_custom_order(
        kept, "round_code", ["R4", "R3", "R1"], ["closing_rank", "record_id"]
    ).limit(40)


@register
def college_prefixes(s: Star) -> DataFrame:
    return look.prefix_counts(s.colleges(), "college_code").withColumnRenamed("records", "colleges")


@register
def part_prefixes(s: Star) -> DataFrame:
    """First letters of part names, which have many."""
    return look.prefix_counts(s.table("part"), "p_name")


@register
def latest_versions(s: Star) -> DataFrame:
    newest = look.latest_per_key(
        s.versions().withColumn("seq", F.col("source_version_id").cast("long")), ["source_id"], ["created_at", "seq"]
    )
    return newest.select("source_id", "source_version_id", "source_title", "content_hash", "processing_status")


@register
def sample_cutoffs(s: Star) -> DataFrame:
    return look.sample_rows(s.cutoffs().select("record_id", "closing_rank"), "record_id", 30, 7)


@register
def provenance_sample(s: Star) -> DataFrame:
    versions = s.versions().filter("processing_status = 'PUBLISHED'").select("source_version_id", "content_hash")
    return look.provenance_sample(s.colleges().select("college_id", "college_code"), "college_id", versions, 4, 7)


@register
def distinct_counts(s: Star) -> DataFrame:
    return look.distinct_counts(
        s.cutoffs(),
        {"colleges": ["college_id"], "branches": ["branch_id"], "combos": ["college_id", "branch_id"],
         "cells": ["college_id", "branch_id", "category_code", "round_code"]},
    )


@register
def duplicate_keys(s: Star) -> DataFrame:
    return look.duplicate_keys(s.table("lineitem"), ["l_orderkey", "l_linenumber"])


# monitoring -----------------------------------------------------------------

NOW = "2024-02-01 00:00:00"


def _freshness(s: Star) -> DataFrame:
    versions = s.versions().withColumn("source_version_id", F.col("source_version_id").cast("long"))
    return mon.source_freshness(s.sources(), versions, s.reviews(), f"'{NOW}'")


@register
def freshness(s: Star) -> DataFrame:
    return _freshness(s).drop("last_checked_at", "latest_published_at")


@register
def freshness_summary(s: Star) -> DataFrame:
    return mon.freshness_summary(_freshness(s))


@register
def data_health(s: Star) -> DataFrame:
    return mon.data_health(
        s.colleges(), s.branches(), s.cutoffs(), s.seats(), s.fees(), s.sources(), s.versions(), s.errors()
    )


@register
def recent_runs(s: Star) -> DataFrame:
    return mon.recent_runs(s.runs()).drop("started_at", "finished_at")


@register
def run_history(s: Star) -> DataFrame:
    return mon.run_history(s.runs()).drop("started_at", "finished_at")


@register
def latest_good_run(s: Star) -> DataFrame:
    return mon.latest_good_run(s.runs()).drop("started_at", "finished_at")


@register
def pending_reviews(s: Star) -> DataFrame:
    return mon.pending_reviews(s.reviews()).drop("created_at")


@register
def reviews_by_status(s: Star) -> DataFrame:
    return mon.reviews_by_status(s.reviews())


@register
def round_counts(s: Star) -> DataFrame:
    return mon.records_by_round(s.seats(), s.rounds())


@register
def records_by_source(s: Star) -> DataFrame:
    """Lines and failed arrivals of every document version; a line belongs to the version of its order."""
    facts = s.table("lineitem").select(F.col("l_orderkey").cast("string").alias("source_version_id"))
    versions = s.versions().select("source_version_id", "source_title")
    return mon.records_by_source(versions, facts, s.errors())


@register
def reconcile(s: Star) -> DataFrame:
    lines, orders, cutoffs = s.table("lineitem"), s.table("orders"), s.cutoffs()
    return mon.reconcile(
        [
            ("lines", lines, s.lines()),
            ("orders with lines", orders, lines.select("l_orderkey").distinct()),
            ("panel", cutoffs, s.panel(status=None)),
            ("published", cutoffs.filter("status = 'PUBLISHED'"), s.panel()),
        ]
    )


# prediction -----------------------------------------------------------------


def _predictions(s: Star, *rounds: str) -> DataFrame:
    facts, wide = s.kept()
    asked = s.requests(facts).filter(F.upper("round").isin(*rounds)) if rounds else s.requests(facts)
    return pre.predict(asked, wide, s.colleges(), s.branches(), BASE_YEAR)


def _flat(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "request_id", "college_id", "branch_id", "academic_year", "category", "program_type", "round", "status",
        "predicted_closing_rank", "lower_bound", "upper_bound",
        "prediction_interval.interval_type", "prediction_interval.target_coverage",
        "prediction_interval.interval_width", "prediction_interval.relative_width", "evidence_strength", "observation_count", "latest_comparable_year", "cold_start_reason", "model_name",
    )


@register
def pred_r1(s: Star) -> DataFrame:
    return _flat(_predictions(s, "R1"))


@register
def pred_r3(s: Star) -> DataFrame:
    return _flat(_predictions(s, "R3"))


@register
def pred_terminal(s: Star) -> DataFrame:
    return _flat(_predictions(s, "R4", "TERMINAL"))


@register
def pred_evidence(s: Star) -> DataFrame:
    """The evidence trail of every prediction, one row per item."""
    items = _predictions(s).select("request_id", F.posexplode("evidence_trail").alias("position", "item"))
    return items.select("request_id", "position", "item.*")


@register
def request_rejects(s: Star) -> DataFrame:
    checked = pre.validate_requests(s.requests(), s.colleges(), s.branches(), BASE_YEAR)
    refused = checked.filter(F.col("error_code").isNotNull())
    return refused.selectExpr("request_id", "error_code", f"{pre.ERROR_CLASS} AS error_class")


@register
def learned_movement(s: Star) -> DataFrame:
    return round_columns(pre.learned_movement(s.wide(), YEARS), ["median_relative_move"])


@register
def intervals(s: Star) -> DataFrame:
    return pre.all_intervals(_predictions(s))


@register
def decision(s: Star) -> DataFrame:
    facts, wide = s.kept()
    return pre.decide(s.requests(facts), wide, s.colleges(), s.branches(), BASE_YEAR).drop(
        "explanation", "decision_text", "model_name"
    )


# backtest -------------------------------------------------------------------


@register
def bt_windows(s: Star) -> DataFrame:
    return bt.window_summary(bt.cases(s.wide(), YEARS, "R1"))


@register
def bt_r1_points(s: Star) -> DataFrame:
    return bt.point_metrics(bt.point_forecasts(bt.cases(s.wide(), YEARS, "R1")), [*bt.WINDOW, "model"])


@register
def bt_r1_intervals(s: Star) -> DataFrame:
    return bt.interval_metrics(bt.interval_forecasts(bt.cases(s.wide(), YEARS, "R1")), [*bt.WINDOW, "model"])


@register
def bt_terminal(s: Star) -> DataFrame:
    return bt.point_metrics(bt.point_forecasts(bt.cases(s.wide(), YEARS, "TERMINAL")), [*bt.WINDOW, "model"])


@register
def bt_terminal_intervals(s: Star) -> DataFrame:
    return bt.interval_metrics(bt.interval_forecasts(bt.cases(s.wide(), YEARS, "TERMINAL")), [*bt.WINDOW, "model"])


@register
def bt_depth(s: Star) -> DataFrame:
    return bt.depth_breakdown(bt.point_forecasts(bt.cases(s.wide(), YEARS, "R1")))


@register
def leakage_violations(s: Star) -> DataFrame:
    return bt.leakage_violations(bt.training_rows(s.panel(status=None), YEARS), YEARS)


@register
def seat_correlation(s: Star) -> DataFrame:
    return bt.seat_correlation(s.wide(), s.seats(), s.branches(), 2001, 2000)


# quality --------------------------------------------------------------------

CATEGORIES = ["GM", "KKR"]


def _checked(tagged: DataFrame) -> DataFrame:
    out = tagged.select("row_idx", "error_codes", "anomalies", "is_valid")
    return join_arrays(out, ["error_codes", "anomalies"])


def _tagged_cutoffs(s: Star) -> DataFrame:
    return dq.validate_cutoffs(s.raw_cutoffs(), s.registry_colleges(), s.registry_branches(), CATEGORIES)


@register
def dq_cutoff(s: Star) -> DataFrame:
    return _checked(_tagged_cutoffs(s))


@register
def dq_seat(s: Star) -> DataFrame:
    return _checked(dq.validate_seats(s.raw_seats(), s.registry_colleges(), s.registry_branches()))


@register
def dq_fee(s: Star) -> DataFrame:
    return _checked(dq.validate_fees(s.raw_fees(), s.registry_colleges(), s.registry_branches()))


@register
def dq_errors(s: Star) -> DataFrame:
    """Errors and remarks of the cutoff rows, counted by code."""
    found = dq.error_rows(_tagged_cutoffs(s), "CUTOFF")
    return found.groupBy("entity_type", "error_code", "severity").agg(F.expr("count(1) AS found"))


@register
def dq_completeness(s: Star) -> DataFrame:
    tagged = dq.validate_cutoffs(
        s.raw_cutoffs(), s.registry_colleges(), s.registry_branches(), CATEGORIES, ["source_version_id"]
    )
    outcomes = dq.document_outcomes(tagged, s.raw_documents(), dq.thresholds_frame(s.spark))
    return outcomes.select(
        "source_version_id", "document_type", "program_type", "candidate_records", "extracted_count",
        "rejected_records", "minimum_rows", "error_code", "failure_reason", "processing_status",
    )


@register
def dq_publishable(s: Star) -> DataFrame:
    """Rows left to publish per document."""
    tagged = dq.validate_cutoffs(
        s.raw_cutoffs(), s.registry_colleges(), s.registry_branches(), CATEGORIES, ["source_version_id"]
    )
    outcomes = dq.document_outcomes(tagged, s.raw_documents(), dq.thresholds_frame(s.spark))
    rows = dq.publishable_rows(tagged, outcomes)
    return rows.groupBy("source_version_id").agg(F.expr("count(1) AS publishable"))


@register
def dq_audit(s: Star) -> DataFrame:
    return dq.audit(s.colleges(), s.branches(), s.cutoffs(), s.seats(), s.fees())


@register
def dq_orphans(s: Star) -> DataFrame:
    """Requests for colleges that do not exist."""
    return dq.orphans(s.requests().select("request_id", "college_id"), s.colleges(), "college_id")


# publishing -----------------------------------------------------------------


VERSION_ORDER = "CAST(substring_index(source_version_id, 'v', -1) AS INT)"  # the binding's versions end in v1, v2


def _publish(s: Star) -> tuple[DataFrame, DataFrame]:
    existing = s.version_facts("source_version_id = 'v1' OR o_orderstatus <> 'O'")
    incoming = s.version_facts("source_version_id = 'v2'")
    rounds = s.rounds().filter("NOT (academic_year = 1999 AND round_code = 'R4')")
    return pub.publish_outcomes(incoming, existing, rounds), existing


@register
def publish_outcome(s: Star) -> DataFrame:
    return _publish(s)[0].drop("status")


@register
def publish_state(s: Star) -> DataFrame:
    outcomes, existing = _publish(s)
    return pub.publish_state(outcomes, existing, VERSION_ORDER)


@register
def publish_report(s: Star) -> DataFrame:
    return pub.publish_report(*_publish(s), VERSION_ORDER)


@register
def publish_seats(s: Star) -> DataFrame:
    """Seats absent from the store, which holds those of the first version and those without a round."""
    seats = s.seats()
    existing = seats.filter("source_version_id = 'v1' OR round_code IS NULL")
    return pub.publish_absent(seats, existing, pub.SEAT_KEY).drop("category_code", "created_at")


@register
def publish_fees(s: Star) -> DataFrame:
    """Fees absent from the store, which holds those up to 1998 as they are, and all later ones under v2."""
    fees = s.fees().withColumn("source_version_id", F.expr("CASE WHEN total_fee % 200 < 100 THEN 'v1' ELSE 'v2' END"))
    existing = fees.filter("academic_year <= 1998").unionByName(
        fees.filter("academic_year > 1998").withColumn("source_version_id", F.lit("v2"))
    )
    return pub.publish_absent(fees, existing, pub.FEE_KEY)


@register
def college_upsert(s: Star) -> DataFrame:
    nation = F.expr("CAST(substring_index(location, '_', -1) AS INT)")
    colleges = s.colleges().withColumn("_n", nation)
    existing = colleges.filter("_n < 15").withColumn("location", F.expr("CASE WHEN _n >= 5 THEN location END"))
    found = colleges.filter("_n >= 3").withColumn(
        "institution_type", F.expr("CASE WHEN _n < 8 THEN 'MEDICAL' WHEN _n < 11 THEN '' ELSE institution_type END")
    )
    keep = ["college_code", "college_name", "original_name", "location", "institution_type"]
    return pub.upsert_colleges(found.select(*keep), existing.select(*keep))


def _found_branches(s: Star) -> DataFrame:
    """Branch codes from the initials of part names, named after a part."""
    words = {"ECONOMY": " and Planning", "LARGE": " Architecture", "SMALL": " Bachelor of Design"}
    tail = " ".join(f"WHEN '{t}' THEN '{w}'" for t, w in words.items())
    return (
        s.table("part")
        .groupBy(F.expr("upper(concat(left(p_name, 1), left(substring_index(p_name, ' ', -1), 1))) AS branch_code"))
        .agg(F.expr(f"max(concat(p_name, CASE p_type {tail} ELSE '' END)) AS branch_name"))
    )


@register
def branch_classify(s: Star) -> DataFrame:
    return pub.classify_branches(_found_branches(s))


@register
def branch_upsert(s: Star) -> DataFrame:
    found = _found_branches(s)
    existing = found.filter("branch_code > 'M'").selectExpr(
        "branch_code", "branch_name", "'ENGINEERING' AS program_type", "true AS is_canonical"
    )
    return pub.upsert_branches(found.filter("branch_code < 'S'"), existing)


@register
def round_remap(s: Star) -> DataFrame:
    moved = pub.remap_rounds(s.cutoffs(), {"MOCK": "R1", "R3": "R4"}, [1995, 1996])
    return moved.groupBy("academic_year", "round_code").agg(F.expr("count(1) AS records"))


@register
def type_backfill(s: Star) -> DataFrame:
    by_code = {"S00001": "MEDICAL", "S00002": "DENTAL"}
    return pub.backfill_institution_type(s.colleges(), by_code, {"S0000": "ARCHITECTURE"}).select(
        "college_code", "institution_type"
    )


@register
def review_upsert(s: Star) -> DataFrame:
    reviews = s.reviews().withColumn("review_notes", F.lit("first"))
    old = reviews.filter("created_at < timestamp_ntz'2024-01-16'").drop("failure_id")
    new = reviews.filter("created_at >= timestamp_ntz'2024-01-16'").selectExpr(
        "source_id", "document_url", "failure_reason", "'again' AS review_notes", "created_at", "item_id AS failure_id"
    )
    return pub.upsert_reviews(old, new).drop("created_at", "reviewed_by")


@register
def review_moves(s: Star) -> DataFrame:
    """Review items after decisions of reviewers: large values are approved, with a note."""
    items = s.reviews().withColumns({"reviewed_by": F.lit(None).cast("string"), "review_notes": F.col("document_url")})
    moves = items.filter("status = 'PENDING_REVIEW'").selectExpr(
        "item_id", "'APPROVED' AS new_status", "source_id AS reviewer",
        "CASE WHEN source_id < '5' THEN 'seen' END AS notes",
    )
    return pub.move_reviews(items, moves).drop("created_at")


# documents and text ---------------------------------------------------------


@register
def anchors(s: Star) -> DataFrame:
    """Every link of the raw web pages, resolved."""
    return pages.anchors(s.table("pages"))


@register
def links(s: Star) -> DataFrame:
    return pages.discover_links(pages.anchors(s.portal_pages()), 2026)


@register
def html_tables(s: Star) -> DataFrame:
    return pages.colleges_from_tables(pages.html_tables(s.directory_pages()))


@register
def branch_tables(s: Star) -> DataFrame:
    """Branches listed under the fixed heading of pages made of parts."""
    return pages.branches_from_pages(s.branch_pages())


@register
def doc_class(s: Star) -> DataFrame:
    """Type, round, year, program and date of whole document texts."""
    t = F.col("text")
    return s.table("documents").select(
        "doc_id", tx.document_type(t).alias("document_type"), tx.link_type(t).alias("guessed_type"),
        tx.document_round(t).alias("round_code"), tx.document_year(t, 2026).alias("academic_year"),
        tx.document_program(t).alias("program_type"),
    )


@register
def round_names(s: Star) -> DataFrame:
    """Rounds from free text: order priorities, and the words people use for rounds."""
    words = F.array(*[F.lit(w) for w in (
        "Round 1", "mock allotment", "ROUND 2 PHASE 1", "Round 2 Phase 2", "r2", "after all rounds", "Round-3", "R4", "%%")])
    labels = s.table("orders").select(
        F.explode(F.concat(F.array("o_orderpriority"), F.array(F.get(words, (F.col("o_orderkey") % 9).cast("int"))))).alias("label")
    ).distinct()
    return labels.withColumn("r", tx.round_of(F.col("label"))).selectExpr(
        "label", "r.code AS round_code", "r.name AS round_name", "r.number AS round_number"
    )


@register
def name_rules(s: Star) -> DataFrame:
    """Normal forms of part names and codes."""
    part = s.table("part")
    raw = F.expr("concat(' ', p_name, '  of b.m.s. AND ', p_type, ' at  ', p_brand, '- ion')")
    return part.select(
        "p_partkey",
        tx.clean_text(raw).alias("cleaned"),
        tx.college_code(F.col("p_brand")).alias("code"),
        tx.college_name(raw).alias("college_name"),
        tx.location(raw).alias("location"),
        tx.branch_name(F.expr("concat(p_name, '- ion&', p_type, '-  Design')")).alias("branch_name"),
        tx.category_code(F.expr("CASE WHEN p_size % 2 = 0 THEN ' gen ' ELSE p_type END")).alias("category"),
        tx.digits_int(F.col("p_brand")).alias("digits"),
        tx.is_web_address(F.expr("concat(CASE WHEN p_size % 3 = 0 THEN 'ftp' ELSE 'https' END, '://h/', p_brand)")).alias("is_url"),
        F.expr(f"{rank_text('p_partkey * 1234')} AS thousands"),
    )


@register
def doc_integrity(s: Star) -> DataFrame:
    """Pages under a .pdf address must be PDF."""
    checked = pages.integrity(s.table("pages"), "html", "page_id % 3 = 0")
    return checked.select("page_id", "is_ok", "reason")


@register
def fingerprint_dedup(s: Star) -> DataFrame:
    docs = s.table("documents").select("doc_id", "source", "text")
    return pages.fingerprints(docs, "source", "doc_id", "text")


@register
def not_archived(s: Star) -> DataFrame:
    """Documents whose content their source has not archived; the archive holds every third document."""
    docs = s.table("documents").select("doc_id", "source", tx.sha256_hex(F.col("text")).alias("content_hash"))
    return pages.not_archived(docs, docs.filter("doc_id % 3 = 0"), "source")


@register
def usable_text(s: Star) -> DataFrame:
    """A document's first line stands for its first pages."""
    first, whole = F.length(F.substring_index("text", "\n", 1)), F.length("text")
    kind = F.when(F.col("doc_id") % 2 == 0, "CUTOFF_PDF").otherwise("FEE_STRUCTURE_PDF")
    return s.table("documents").select("doc_id", pages.text_state(first, whole, kind).alias("status"))


def _grid_records(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "layout", "college_code", "college_name", "category_code", "branch_code", "branch_name",
                       "academic_year", "round_code", "closing_rank", "page_number")


@register
def grid_wide(s: Star) -> DataFrame:
    return _grid_records(grids.parse(s.wide_grid(), "CUTOFF_PDF"))


@register
def grid_vertical(s: Star) -> DataFrame:
    return _grid_records(grids.cutoff_rows(s.vertical_grid()))


@register
def grid_categories(s: Star) -> DataFrame:
    return _grid_records(grids.cutoff_rows(s.category_grid()))


def _seat_lines(s: Star) -> DataFrame:
    return grids.parse(s.seat_grid(), "SEAT_MATRIX_PDF")


@register
def seat_grid(s: Star) -> DataFrame:
    return grids.seat_rows(_seat_lines(s)).drop("doc_id", "page_number", "branch_name", "college_name")


@register
def fee_grid(s: Star) -> DataFrame:
    fees = grids.fee_rows(_seat_lines(s)).drop("doc_id", "page_number", "currency")
    return fees.withColumns({c: F.col(c).cast("double") for c in ("total_fee", "tuition_fee", "other_fee")})


@register
def grid_states(s: Star) -> DataFrame:
    """Which documents parsed cleanly."""
    lines = _seat_lines(s)
    documents = s.seat_grid().select("doc_id", "academic_year").distinct()
    return grids.document_states(documents, grids.seat_rows(lines), grids.malformed_rows(lines))


@register
def source_sync(s: Star) -> DataFrame:
    """Sources renewed from a configuration of one entry per nation, known by code or by address."""
    existing = s.sources().selectExpr(
        "source_id", "source_code", "concat('http://', source_id) AS url", "title", "'LOW' AS authority_level", "is_enabled",
        "check_frequency_hours", "'OTHER' AS document_type", "'v1' AS parser_version", "last_checked_at",
    )
    configured = s.table("nation").selectExpr(
        "CASE WHEN n_nationkey < 10 THEN concat('SRC-', n_nationkey) ELSE concat('NEW-', n_nationkey) END AS source_code",
        "CASE WHEN n_nationkey < 20 THEN concat('http://', n_nationkey) ELSE concat('http://n/', n_nationkey) END AS url",
        "n_name AS title", "'HIGH' AS authority_level", "true AS is_enabled", "12 AS check_frequency_hours",
        "'CUTOFF_PDF' AS document_type", "'v2' AS parser_version",
    )
    return registry.sync_sources(existing, configured).drop("last_checked_at", "source_id")


@register
def seed_rounds(s: Star) -> DataFrame:
    """Rounds that orders show, all flagged general, put right and completed from the calendar."""
    seen = s.cutoffs().filter("academic_year < 1999").select("academic_year", "round_code").distinct()
    existing = seen.selectExpr("academic_year", "round_code", "round_code AS round_name", "9 AS round_number", "true AS is_general_round")
    return registry.seed_rounds(existing, s.calendar)


@register
def document_report(s: Star) -> DataFrame:
    tagged = dq.validate_cutoffs(
        s.raw_cutoffs(), s.registry_colleges(), s.registry_branches(), CATEGORIES, ["source_version_id"]
    )
    outcomes = dq.document_outcomes(tagged, s.raw_documents(), dq.thresholds_frame(s.spark))
    return sinks.document_report(tagged, outcomes)


@register
def run_report(s: Star) -> DataFrame:
    return sinks.run_report(document_report(s))


@register
def report(s: Star) -> DataFrame:
    """Every analysis of the panel in one long table."""
    facts, wide = s.kept()
    out = lon.report(s.panel(facts, status=None), wide, [(1995, 1996), (1998, 1999), (1995, 2001)], 2001)
    return round_columns(out, ["value"])


# streams --------------------------------------------------------------------


def _daily_arrivals(s: Star) -> DataFrame:
    events = s.stream("events").selectExpr("CAST(user_id AS STRING) AS source_id", "ts", "props AS content")
    out, state = (shared_folder(s.spark, name) for name in ("arrivals", "arrivals-state"))
    arrivals_stream.run_arrivals(events, out, state)
    return arrivals_stream.daily_arrivals(s.spark, out)


@register
def stream_arrivals(s: Star) -> DataFrame:
    return _daily_arrivals(s)


@register
def stream_staleness(s: Star) -> DataFrame:
    return arrivals_stream.staleness(_daily_arrivals(s), "2024-02-01", 24)


@register
def stream_ingest(s: Star) -> DataFrame:
    """Raw line items streamed through validation, gate and publishing; the resulting facts."""
    job = CutoffIngest(
        shared_folder(s.spark, "ingest"), s.registry_colleges(), s.registry_branches(), s.rounds(), CATEGORIES,
        VERSION_ORDER, s.raw_documents(),
    )
    job.run(s.stream("lineitem"), shared_folder(s.spark, "ingest-state"), s.raw_cutoffs)
    return job.facts().drop("row_identifier")


@register
def stream_late_arrivals(s: Star) -> DataFrame:
    """Arrivals counted from files that each hold rows of all days, one file per trigger: most rows come late."""
    events = s.table("events").selectExpr("CAST(user_id AS STRING) AS source_id", "ts", "props AS content")
    inbox, out, state = (shared_folder(s.spark, name) for name in ("late-inbox", "late", "late-state"))
    events.repartition(6, "content", "ts").write.parquet(inbox)
    stream = s.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(inbox)
    arrivals_stream.run_arrivals(stream, out, state)
    return arrivals_stream.daily_arrivals(s.spark, out)


# history as of a time --------------------------------------------------------

_DAY = "datediff(CAST({} AS DATE), DATE'1970-01-01')"


@register
def asof_history(s: Star) -> DataFrame:
    """What the lines of a college, branch and category, by day of shipping, say before each year of the facts."""
    keys = ["college_id", "branch_id", "category_code"]
    facts = s.lines().selectExpr(*keys, f"{_DAY.format('l_shipdate')} AS day", "CAST(floor(l_extendedprice) AS BIGINT) AS closing")
    targets = s.cutoffs().select(*keys, "academic_year").distinct()
    return as_of(targets, facts, keys, _DAY.format("make_date(academic_year, 1, 1)"), "day", "closing", span=365)


def _open_cases(s: Star) -> DataFrame:
    return bt.open_cases(s.ship_cells(), "ship_year")


@register
def bt_windows_open(s: Star) -> DataFrame:
    """Combos tested per year of shipping; the years are those of the table."""
    return bt.window_summary(_open_cases(s))


@register
def bt_points_open(s: Star) -> DataFrame:
    return bt.point_metrics(bt.point_forecasts(_open_cases(s)), [*bt.WINDOW, "model"])


@register
def bt_intervals_open(s: Star) -> DataFrame:
    return bt.interval_metrics(bt.interval_forecasts(_open_cases(s)), [*bt.WINDOW, "model"])


@register
def leakage_lineage(s: Star) -> DataFrame:
    """The records that first-round cases learned from, checked against all facts."""
    tested = bt.open_cases(s.panel().where("round_code = 'R1'"), record="record_id")
    return bt.leakage_by_lineage(tested, s.cutoffs())


# inputs of the gate ------------------------------------------------------------


def _round_outcomes(s: Star) -> tuple[DataFrame, DataFrame]:
    """Documents of one round and year: those of version v1 first, those of v2 against what v1 published."""
    tagged = dq.validate_cutoffs(
        s.raw_cutoffs(document=s.ROUND_DOCUMENT), s.registry_colleges(), s.registry_branches(), CATEGORIES, ["source_version_id"]
    )
    documents = s.round_documents().withColumns(
        {"is_corrigendum": F.expr(dq.corrigendum("title")), "baseline_count": F.lit(None).cast("bigint")}
    )
    limits = dq.thresholds_frame(s.spark)
    first = dq.document_outcomes(tagged, documents.where("version = 'v1'"), limits)
    known = dq.publishable_rows(tagged, first).where(F.col("category_code").isin(CATEGORIES))
    baseline = pub.published_counts(known.withColumnRenamed("branch_code", "branch_id"), s.branches())
    return first, dq.document_outcomes(tagged, documents.where("version = 'v2'"), limits, baseline)


@register
def dq_baseline(s: Star) -> DataFrame:
    """Later documents of each round, held against the rows published before."""
    return _round_outcomes(s)[1].select(
        "source_version_id", "program_type", "is_corrigendum", "extracted_count", "baseline_count", "minimum_rows", "error_code",
        "processing_status",
    )


@register
def document_anomalies(s: Star) -> DataFrame:
    """Remarks on documents as a whole."""
    first, second = _round_outcomes(s)
    return first.drop("baseline_count").unionByName(second.drop("baseline_count")).select(
        "source_version_id", "extracted_count", "document_anomaly", "processing_status"
    )


@register
def unsupported_documents(s: Star) -> DataFrame:
    """Documents nobody can parse, as they go to review."""
    return grids.without_parser(s.raw_documents()).select("source_version_id", "document_type", "failure_reason")


@register
def error_context(s: Star) -> DataFrame:
    """Every error and remark of the cutoff rows, with the record it is about."""
    return dq.error_rows(_tagged_cutoffs(s), "CUTOFF").select("entity_identifier", "error_code", "severity", "context_data")


@register
def provenance_gaps(s: Star) -> DataFrame:
    """Panel rows that name no source version: those of every seventh college."""
    gaps = s.panel().withColumn("source_version_id", F.expr("CASE WHEN CAST(college_id AS INT) % 7 > 0 THEN source_version_id END"))
    return lon.anomaly_details(lon.missing_provenance(gaps)).select(
        "academic_year", "college_code", "branch_code", "anomaly_type", "cause", "description", "details"
    )


# dimensions --------------------------------------------------------------------


@register
def seed_categories(s: Star) -> DataFrame:
    """Standard categories beside those that are there: one per nation, and one that is a standard one already."""
    existing = s.table("nation").selectExpr(
        "CASE WHEN n_nationkey = 3 THEN 'GM' ELSE n_name END AS category_code", "n_name AS category_name", "'held' AS description"
    )
    return registry.seed_categories(s.spark, existing)


@register
def rounds_dropped(s: Star) -> DataFrame:
    """Rounds and versions after one round was merged into another, with the facts they hold."""
    mapping = {"KKR_SPECIAL": "R3"}
    facts = pub.remap_rounds(s.cutoffs(), mapping).groupBy("academic_year", "round_code").agg(F.expr("count(1) AS records"))
    versions = pub.remap_versions(s.round_documents(), mapping).groupBy("academic_year", "counselling_round").agg(
        F.expr("count(1) AS documents")
    ).withColumnRenamed("counselling_round", "round_code")
    left = pub.drop_unused_rounds(s.rounds(), mapping).select("academic_year", "round_code", "round_name")
    key = ["academic_year", "round_code"]
    return left.join(facts, key, "left").join(versions, key, "left")


@register
def review_resolve(s: Star) -> DataFrame:
    """Review items whose source has published a version since."""
    items = s.reviews().selectExpr(
        "item_id", "concat('of-', source_id) AS source_version_id", "status",
        "CASE WHEN source_id > '5' THEN document_url END AS review_notes",
    )
    done = s.versions().where("processing_status = 'PUBLISHED'").selectExpr("concat('of-', source_id) AS source_version_id")
    return pub.resolve_reviews(items, done)


@register
def source_filtered(s: Star) -> DataFrame:
    """Sources of one year and type with their versions."""
    sources = s.sources().selectExpr(
        "*", "CAST(2023 + CAST(source_id AS INT) % 3 AS INT) AS academic_year",
        "CASE WHEN CAST(source_id AS INT) % 2 = 0 THEN 'CUTOFF_PDF' ELSE 'OTHER' END AS document_type",
    )
    found = look.source_catalogue(sources, s.versions(), academic_year=2024, document_type="CUTOFF_PDF")
    return found.drop("last_checked_at", "version_created_at")


@register
def number_forms(s: Star) -> DataFrame:
    """Amounts as the pages show them: with a sign, and in units of a hundred thousand."""
    return s.table("supplier").selectExpr(
        "s_suppkey", f"{signed_thousands('floor(s_acctbal)')} AS signed", f"{in_lakhs('floor(s_acctbal) * 1000')} AS lakhs"
    )


# sentences and choices -----------------------------------------------------------


@register
def pred_explanations(s: Star) -> DataFrame:
    """The lines that explain each prediction, or say why there is none."""
    # a plain explode would have the optimizer infer filters on the whole expression; no explanation is empty
    return _predictions(s).select("request_id", "status", F.posexplode_outer("explanation").alias("position", "line"))


@register
def decision_texts(s: Star) -> DataFrame:
    facts, wide = s.kept()
    return pre.decide(s.requests(facts), wide, s.colleges(), s.branches(), BASE_YEAR).select("request_id", "decision_text")


@register
def choices(s: Star) -> DataFrame:
    """Each customer's rank against every college and branch of their orders in 2000, as first-round choices."""
    order, part = s.table("orders").where("year(o_orderdate) = 2000"), s.table("part")
    chosen = (
        s.table("lineitem").join(order, F.expr("l_orderkey = o_orderkey")).join(part, F.expr("l_partkey = p_partkey"))
        .selectExpr("o_custkey AS customer", "CAST(l_suppkey AS STRING) AS college_id", "p_type AS branch_id").distinct()
        .selectExpr("*", "CAST(customer * 137 % 90000 + 1 AS INT) AS candidate_rank",
                    "'GM' AS category", "2000 AS academic_year", "'R1' AS round")
    )
    asked = s.requests().where("round = 'R1' AND academic_year = 2000 AND category = 'GM' AND request_id LIKE '%v2'")
    predictions = pre.predict(asked, s.wide(), s.colleges(), s.branches(), BASE_YEAR).drop("branch_id")
    return pre.score_choices(chosen, predictions.withColumnRenamed("raw_branch_id", "branch_id"))


@register
def recency_terminal(s: Star) -> DataFrame:
    return round_columns(
        lon.recency_evidence(s.wide(), 2001, "TERMINAL"),
        ["recent_median_relative_distance", "older_median_relative_distance", "recent_closer_percentage"],
    )


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
