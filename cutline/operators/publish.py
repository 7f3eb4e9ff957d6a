"""Versioned publishing and upserts, written as joins over whole tables.

Facts are append-only: a newer version supersedes a published fact and never
changes its values. Every function returns the new state or the outcome of
each row; ``sources.sinks`` writes them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.sql import case, columns, text, texts
from cutline.plans.pooled import lookup
from cutline.schemas import CUTOFF_KEY

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

BRANCH_ALIASES = {"BDC": "DC", "BIN": "BI", "BPL": "BP", "ECV": "ED", "ECS": "EC"}
NOT_CANONICAL_WITHOUT_TARGET = ["CM"]
DESIGN_CODES = ["BD", "BDC", "BI", "BIN", "DC", "DF", "DI", "DL"]
PLANNING_CODES = ["BP", "BPL", "IMP"]

# ---------------------------------------------------------------------------


def publish_outcomes(
    incoming: DataFrame, existing: DataFrame, rounds: DataFrame, categories: list[str] | None = None
) -> DataFrame:
    """What happens to each valid incoming cutoff.

    PUBLISHED, UNCHANGED (same version, same rank), FACTUAL_MUTATION_REJECTED
    (same version, other rank), UNKNOWN_COUNSELLING_ROUND, or UNKNOWN_CATEGORY
    if the known categories are given. Incoming rows are unique per key and
    version, as the validator leaves them.
    """
    key = [*CUTOFF_KEY, "source_version_id"]
    held = existing.selectExpr(*key, "closing_rank AS _held_rank")
    known = rounds.selectExpr("academic_year", "round_code", "true AS _round")
    outcome = case(
        (f"category_code NOT IN {texts(categories)}" if categories else "false", "'UNKNOWN_CATEGORY'"),
        ("_round IS NULL", "'UNKNOWN_COUNSELLING_ROUND'"),
        ("_held_rank IS NULL", "'PUBLISHED'"),
        ("_held_rank <> closing_rank", "'FACTUAL_MUTATION_REJECTED'"),
        default="'UNCHANGED'",
    )
    return (
        incoming.join(known, ["academic_year", "round_code"], "left")
        .join(held, key, "left")
        .withColumn("outcome", F.expr(outcome))
        .drop("_round", "_held_rank")
    )


def publish_state(outcomes: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """The facts after publishing: old rows, superseded where a new one came, and the new rows.

    Where one batch brings several versions of a key, the last to arrive is
    published and the others are superseded at once. ``order`` is SQL text over
    the outcomes that grows with the arrival of a version, such as a time or a
    number; names of versions have no order of their own and only part ties.
    """
    new = outcomes.filter("outcome = 'PUBLISHED'").drop("outcome", "status")
    new = new.withColumn("_arrival", F.expr(f"struct({order} AS at, source_version_id)"))
    newest = new.groupBy(*CUTOFF_KEY).agg(F.max("_arrival").alias("_newest"))
    # (key, version) is unique, so no key is hot on either side
    new = (
        new.join(newest, CUTOFF_KEY)
        .withColumn("status", F.expr("CASE WHEN _arrival = _newest THEN 'PUBLISHED' ELSE 'SUPERSEDED' END"))
        .drop("_arrival", "_newest")
    )
    kept = (
        existing.join(newest, CUTOFF_KEY, "left")
        .withColumn(
            "status",
            F.expr("CASE WHEN _newest IS NOT NULL AND status = 'PUBLISHED' THEN 'SUPERSEDED' ELSE status END"),
        )
        .drop("_newest")
    )
    return kept.unionByName(new, allowMissingColumns=True)


def publish_report(outcomes: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Counts of each outcome per version, and of the held rows that each version, first to arrive, supersedes."""
    per_version = outcomes.groupBy("source_version_id").agg(
        F.expr("count(1) AS candidate_records"),
        F.expr("count_if(outcome = 'PUBLISHED') AS published_records"),
        F.expr("count_if(outcome = 'UNCHANGED') AS verified_unchanged_records"),
        F.expr("count_if(outcome = 'FACTUAL_MUTATION_REJECTED') AS rejected_records"),
        F.expr("count_if(outcome IN ('UNKNOWN_COUNSELLING_ROUND', 'UNKNOWN_CATEGORY')) AS unknown_dimensions"),
    )
    new = outcomes.filter("outcome = 'PUBLISHED'").groupBy(*CUTOFF_KEY).agg(
        F.expr(f"min_by(source_version_id, struct({order} AS at, source_version_id)) AS _by")
    )
    superseded = (
        existing.filter("status = 'PUBLISHED'")
        .join(new, CUTOFF_KEY)
        .groupBy(F.expr("_by AS source_version_id"))
        .agg(F.expr("count(1) AS _superseded"))
    )
    return per_version.join(superseded, "source_version_id", "left").withColumn(
        "superseded_records", F.expr("coalesce(_superseded, 0L)")
    ).drop("_superseded")


BASELINE_KEY = ["academic_year", "round_code", "program_type"]


def published_counts(facts: DataFrame, branches: DataFrame) -> DataFrame:
    """Published facts per (academic_year, round_code, program_type): what a new document of the round is held against."""
    programs = branches.select("branch_id", "program_type")
    return (
        lookup(facts.where("status = 'PUBLISHED'"), programs, ["branch_id"])
        .groupBy(*BASELINE_KEY).agg(F.expr("count(1) AS baseline_count"))
    )


def updated_counts(counts: DataFrame, before: DataFrame, after: DataFrame, branches: DataFrame) -> DataFrame:
    """``published_counts`` after a change, from the parts of the store it touched, as they were and as they are."""
    gone = published_counts(before, branches).withColumn("baseline_count", F.expr("-baseline_count"))
    return (
        counts.select(*BASELINE_KEY, "baseline_count").union(gone).union(published_counts(after, branches))
        .groupBy(*BASELINE_KEY).agg(F.expr("sum(baseline_count) AS baseline_count")).where("baseline_count <> 0")
    )


def publish_absent(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Seats and fees: only rows whose exact key and version is absent; NULLs are equal."""
    held = existing.selectExpr(*[f"{k} AS _{k}" for k in keys])
    same = " AND ".join(f"{k} <=> _{k}" for k in keys)
    return incoming.join(held, F.expr(same), "left_anti").withColumn("status", F.lit("PUBLISHED"))


SEAT_KEY = ["source_version_id", "college_id", "branch_id", "category_code", "round_code", "academic_year"]
FEE_KEY = ["source_version_id", "college_id", "branch_id", "academic_year"]


# upserts ----------------------------------------------------------------------


def upsert_colleges(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert new colleges; fill an empty location; take over a given institution type.

    ``outcome`` says INSERTED, UPDATED, UNCHANGED, or KEPT for those not found this time.
    """
    given = found.selectExpr(
        "college_code", "college_name AS _name", "original_name AS _original", "location AS _location",
        "institution_type AS _type", "true AS _found",
    )
    held = existing.withColumn("_held", F.lit(True))
    fills = "nullif(location, '') IS NULL AND nullif(_location, '') IS NOT NULL"
    retypes = "nullif(_type, '') IS NOT NULL AND NOT (institution_type <=> _type)"
    outcome = case(
        ("_held IS NULL", "'INSERTED'"),
        ("_found IS NULL", "'KEPT'"),
        (f"({fills}) OR ({retypes})", "'UPDATED'"),
        default="'UNCHANGED'",
    )
    return (
        held.join(given, "college_code", "full")
        .withColumn("outcome", F.expr(outcome))
        .selectExpr(
            "college_code",
            "coalesce(college_name, _name) AS college_name",
            "coalesce(original_name, _original) AS original_name",
            "coalesce(nullif(location, ''), _location) AS location",
            "coalesce(nullif(_type, ''), institution_type, 'ENGINEERING') AS institution_type",
            "outcome",
        )
    )


def branch_program(code: str, name: str) -> str:
    """Program of a branch from its code and normal name (SQL text)."""
    upper = f"upper({name})"
    return case(
        (f"{code} = 'AT' OR contains({upper}, 'ARCHITECTURE')", "'ARCHITECTURE'"),
        (
            f"{code} IN {texts(DESIGN_CODES)} OR contains({upper}, 'BACHELOR OF DESIGN') "
            f"OR contains({upper}, 'B. DESIGN')",
            "'DESIGN'",
        ),
        (f"{code} IN {texts(PLANNING_CODES)} OR contains({upper}, 'PLANNING')", "'OTHER'"),
        default="'ENGINEERING'",
    )


def classify_branches(found: DataFrame) -> DataFrame:
    """Program, canonical flag and alias target of each found branch (branch_code, branch_name).

    An alias points to its canonical code only if that code is there as well.
    """
    aliases = ", ".join(f"({text(a)}, {text(c)})" for a, c in BRANCH_ALIASES.items())
    targets = found.sparkSession.sql(f"SELECT * FROM VALUES {aliases} AS a(_alias, _target)")
    present = found.selectExpr("branch_code AS _present").distinct()
    canonical = f"_target IS NULL AND branch_code NOT IN {texts(NOT_CANONICAL_WITHOUT_TARGET)}"
    return (
        found.join(targets, F.expr("branch_code = _alias"), "left")
        .join(present, F.expr("_target = _present"), "left")
        .withColumns(
            columns(
                {
                    "program_type": branch_program("branch_code", "branch_name"),
                    "is_canonical": canonical,
                    "canonical_code": "_present",
                }
            )
        )
        .drop("_alias", "_target", "_present")
    )


def upsert_branches(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert new branches; correct program and canonical flag of known ones; names stay."""
    # an alias may point to a branch found earlier, so classify over both
    new = found.join(existing.select("branch_code"), "branch_code", "left_anti").select("branch_code", "branch_name")
    both = existing.select("branch_code", "branch_name").unionByName(new)
    given = found.selectExpr("branch_code", "branch_name AS _given").distinct()
    classified = classify_branches(both).join(given, "branch_code", "left")
    held = existing.selectExpr(
        "branch_code", "program_type AS _program", "is_canonical AS _canonical", "true AS _held"
    )
    differs = "NOT (_program <=> program_type AND _canonical <=> is_canonical)"
    outcome = case(
        ("_held IS NULL", "'INSERTED'"), ("_given IS NULL", "'KEPT'"), (differs, "'UPDATED'"), default="'UNCHANGED'"
    )
    return (
        classified.withColumn("program_type", F.expr(branch_program("branch_code", "coalesce(_given, branch_name)")))
        .join(held, "branch_code", "left")
        .withColumn("outcome", F.expr(outcome))
        .withColumns(
            columns(
                {
                    "program_type": "CASE WHEN outcome = 'KEPT' THEN _program ELSE program_type END",
                    "is_canonical": "CASE WHEN outcome = 'KEPT' THEN _canonical ELSE is_canonical END",
                }
            )
        )
        .drop("_given", "_program", "_canonical", "_held")
    )


def remap_rounds(facts: DataFrame, mapping: Mapping[str, str], years: list[int] | None = None) -> DataFrame:
    """Move facts from one round code to another, in all years or only the given ones."""
    within = f"academic_year IN ({', '.join(map(str, years))})" if years else "true"
    new = case(*[(f"{within} AND round_code = {text(a)}", text(b)) for a, b in mapping.items()], default="round_code")
    return facts.withColumn("round_code", F.expr(new))


def remap_versions(versions: DataFrame, mapping: Mapping[str, str], column: str = "counselling_round") -> DataFrame:
    """Source versions with the round codes they name moved likewise, in all years."""
    new = case(*[(f"{column} = {text(a)}", text(b)) for a, b in mapping.items()], default=column)
    return versions.withColumn(column, F.expr(new))


def drop_unused_rounds(rounds: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """The round dimension without the codes that were moved away."""
    return rounds.filter(f"round_code NOT IN {texts(list(mapping))}")


def backfill_institution_type(colleges: DataFrame, by_code: Mapping[str, str], by_prefix: Mapping[str, str]) -> DataFrame:
    """Set the type from a list of codes, then from the first letters of the code."""
    rules = [(f"college_code = {text(c)}", text(t)) for c, t in by_code.items()]
    rules += [(f"startswith(college_code, {text(p)})", text(t)) for p, t in by_prefix.items()]
    return colleges.withColumn("institution_type", F.expr(case(*rules, default="institution_type")))


# review queue -----------------------------------------------------------------


def upsert_reviews(items: DataFrame, failures: DataFrame) -> DataFrame:
    """The queue after new failures: one pending item per (source, document).

    The newest failure of a document overwrites its pending item, or opens
    one. ``failures``: source_id, document_url, failure_reason, review_notes,
    created_at, failure_id (unique).
    """
    newest = failures.groupBy("source_id", "document_url").agg(
        F.expr("max_by(struct(failure_reason, review_notes, created_at, failure_id), struct(created_at, failure_id)) AS _f")
    )
    pending = "status = 'PENDING_REVIEW'"
    joined = items.withColumn("_pending", F.expr(f"CASE WHEN {pending} THEN document_url END")).join(
        newest.withColumnsRenamed({"source_id": "_s", "document_url": "_d"}),
        F.expr("source_id = _s AND _pending = _d"),
        "left",
    )
    updated = joined.withColumns(
        columns(
            {
                "failure_reason": "coalesce(_f.failure_reason, failure_reason)",
                "review_notes": "coalesce(nullif(_f.review_notes, ''), review_notes)",
            }
        )
    ).drop("_pending", "_s", "_d", "_f")
    waiting = items.filter(pending).select("source_id", "document_url").distinct()
    opened = newest.join(waiting, ["source_id", "document_url"], "left_anti").selectExpr(
        "_f.failure_id AS item_id", "source_id", "document_url", "_f.failure_reason AS failure_reason",
        "'PENDING_REVIEW' AS status", "CAST(NULL AS STRING) AS reviewed_by", "_f.review_notes AS review_notes",
        "_f.created_at AS created_at",
    )
    return updated.unionByName(opened, allowMissingColumns=True)


def move_reviews(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply status moves (item_id, new_status, reviewer, notes); notes are appended, not replaced."""
    joined = items.join(moves.withColumnRenamed("item_id", "_id"), F.expr("item_id = _id"), "left")
    appended = "trim(BOTH ' |' FROM concat(coalesce(review_notes, ''), ' | ', notes))"
    return joined.withColumns(
        columns(
            {
                "status": "coalesce(new_status, status)",
                "reviewed_by": "coalesce(nullif(reviewer, ''), reviewed_by)",
                "review_notes": f"CASE WHEN nullif(notes, '') IS NULL THEN review_notes ELSE {appended} END",
            }
        )
    ).drop("_id", "new_status", "reviewer", "notes")


def resolve_reviews(items: DataFrame, published: DataFrame) -> DataFrame:
    """Approve pending items of versions that were published after all."""
    done = published.select("source_version_id").distinct().withColumn("_done", F.lit(True))
    closes = "_done AND status = 'PENDING_REVIEW'"
    return (
        items.join(done, "source_version_id", "left")
        .withColumns(
            columns(
                {
                    "status": f"CASE WHEN {closes} THEN 'APPROVED' ELSE status END",
                    "review_notes": f"CASE WHEN {closes} THEN "
                    "concat(coalesce(review_notes, ''), ' [Resolved: validated and published]') ELSE review_notes END",
                }
            )
        )
        .drop("_done")
    )
