"""Validation of incoming rows, documents and stored facts.

Each validator tags every input row and loses none: ``error_codes`` (empty for
a valid row), ``anomalies`` (remarks that do not reject) and ``is_valid``. The
first rule a row breaks decides, except for the numeric checks of seats and
fees, which all report. In-batch duplicates count only among rows that pass
every other rule, in the order of ``row_idx``. That must be unique: over all
rows, or within a batch where ``batch`` names the columns that tell batches apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.sql import case, columns, text, texts
from cutline.plans.pooled import first_per_key, lookup

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

VALID_ROUNDS = ["R1", "R3", "R4", "MOCK", "KKR_SPECIAL", "R2_PHASE2", "CONSOLIDATED_FINAL"]
MAX_REASONABLE_RANK = 250000
FEE_TOLERANCE = 100
BASELINE_SHARE = 0.3
BASELINE_MINIMUM = 100

# (document type, program) -> fewest rows of a complete document
COMPLETENESS = {
    ("CUTOFF_PDF", "ENGINEERING"): 50,
    ("CUTOFF_PDF", "ARCHITECTURE"): 4,
    ("VACANT_SEATS_PDF", "ENGINEERING"): 50,
    ("VACANT_SEATS_PDF", "ARCHITECTURE"): 4,
    ("SEAT_MATRIX_PDF", "ENGINEERING"): 50,
    ("SEAT_MATRIX_PDF", "ARCHITECTURE"): 4,
    ("FEE_STRUCTURE_PDF", "ENGINEERING"): 50,
    ("FEE_STRUCTURE_PDF", "ARCHITECTURE"): 4,
}
DEFAULT_MINIMUM = {"ENGINEERING": 50, "ARCHITECTURE": 4}

SUSPICIOUS_COLLEGE_CODE = "(?i)^(TEST|COLLEGE|CODE|UNKNOWN|SAMPLE|DUMMY)"
SUSPICIOUS_COLLEGE_NAME = "(?i)(TEST|SAMPLE|DUMMY|COLLEGE NAME)"
SUSPICIOUS_BRANCH_CODE = "(?i)^(TEST|BRANCH|COURSE|CODE|UNKNOWN|SAMPLE|DUMMY)"
SUSPICIOUS_BRANCH_NAME = "(?i)(TEST|SAMPLE|DUMMY)"
PLACEHOLDER = "(?i)^(COLLEGECODE|COLLEGE|BRANCH|COURSE|CODE|UNKNOWN|TEST|SAMPLE|DUMMY)"

# ---------------------------------------------------------------------------


def _blank(column: str) -> str:
    return f"({column} IS NULL OR {column} = '')"


def _registered(rows: DataFrame, registry: DataFrame, column: str, flag: str) -> DataFrame:
    """Mark rows whose code is in a registry of unique codes; hot codes are split by the join."""
    known = registry.select(column).distinct().withColumn(flag, F.lit(True))
    return lookup(rows, known, [column])


def _finish(
    rows: DataFrame, single: str, several: Sequence[str], late: str, key: Sequence[str], batch: Sequence[str],
    dealt: bool = False,
) -> DataFrame:
    """Collect the errors of each row, then find duplicates among the clean ones."""
    each = f"array_compact(array({', '.join(several)}))" if several else "array()"
    rows = rows.withColumns(columns({"_first": single, "_each": f"CAST({each} AS ARRAY<STRING>)"}))
    # a broken early rule hides the numeric ones, and those hide the later rules
    clean = rows.withColumn(
        "error_codes",
        F.expr(
            "CASE WHEN _first IS NOT NULL THEN array(_first) WHEN size(_each) > 0 THEN _each "
            f"ELSE array_compact(array({late})) END"
        ),
    ).drop("_first", "_each")
    marked = first_per_key(clean, key, "row_idx", "size(error_codes) = 0", "_kept", scope=batch, dealt=dealt)
    return marked.withColumns(
        columns(
            {
                "error_codes": "CASE WHEN size(error_codes) = 0 AND NOT _kept "
                "THEN array('DUPLICATE_LOGICAL_RECORD') ELSE error_codes END",
                "is_valid": "_kept",
            }
        )
    ).drop("_kept")


def validate_cutoffs(
    rows: DataFrame, colleges: DataFrame, branches: DataFrame, categories: Sequence[str],
    batch: Sequence[str] = (), dealt: bool = False,
) -> DataFrame:
    """Rules for cutoff rows. ``batch`` names columns that separate batches, if there are several.

    ``dealt`` says that these are never NULL, and spares rows dealt by them and ``row_idx`` another shuffle.
    """
    rows = _registered(rows, colleges, "college_code", "_college")
    rows = _registered(rows, branches, "branch_code", "_branch")
    before_category = case(
        ("_college IS NULL", "'UNKNOWN_COLLEGE_CODE'"),
        ("_branch IS NULL", "'UNKNOWN_BRANCH_CODE'"),
        (f"round_code IS NULL OR round_code NOT IN {texts(VALID_ROUNDS)}", "'INVALID_COUNSELLING_ROUND'"),
    )
    after_category = case(
        ("closing_rank IS NULL OR closing_rank <= 0", "'INVALID_CLOSING_RANK'"),
        ("opening_rank <= 0", "'INVALID_OPENING_RANK'"),
        ("opening_rank > closing_rank", "'OPENING_GREATER_THAN_CLOSING'"),
    )
    rows = rows.withColumns(columns({"_early": before_category, "_ranks": after_category}))
    odd = f"(category_code IS NULL OR category_code NOT IN {texts(categories)})"
    anomalies = (
        f"array_compact(array(CASE WHEN _early IS NULL AND {odd} THEN 'UNEXPECTED_CATEGORY' END, "
        f"CASE WHEN _early IS NULL AND _ranks IS NULL AND closing_rank > {MAX_REASONABLE_RANK} "
        "THEN 'ANOMALOUS_HIGH_RANK' END))"
    )
    rows = rows.withColumn("anomalies", F.expr(anomalies))
    key = [*batch, "college_code", "branch_code", "category_code", "round_code", "academic_year"]
    return _finish(rows, "coalesce(_early, _ranks)", [], "NULL", key, batch, dealt).drop("_college", "_branch", "_early", "_ranks")


def validate_seats(
    rows: DataFrame, colleges: DataFrame, branches: DataFrame, batch: Sequence[str] = ()
) -> DataFrame:
    rows = _registered(rows, colleges, "college_code", "_college")
    rows = _registered(rows, branches, "branch_code", "_branch")
    early = case(
        (_blank("college_code"), "'MISSING_COLLEGE_CODE'"),
        (_blank("branch_code"), "'MISSING_BRANCH_CODE'"),
        ("total_seats IS NULL AND vacant_seats IS NULL", "'MISSING_SEAT_VALUES'"),
        ("_college IS NULL", "'UNKNOWN_COLLEGE_CODE'"),
        ("_branch IS NULL", "'UNKNOWN_BRANCH_CODE'"),
    )
    numeric = [
        f"CASE WHEN {c} < 0 THEN 'INVALID_{c.upper()}' END"
        for c in ("total_seats", "vacant_seats", "gm_seats", "kkr_seats")
    ]
    late = case(
        ("vacant_seats > total_seats", "'VACANCY_EXCEEDS_TOTAL_SEATS'"),
        ("gm_seats + kkr_seats > total_seats", "'SEAT_SUM_EXCEEDS_TOTAL'"),
        ("gm_seats + kkr_seats > vacant_seats", "'SEAT_SUM_EXCEEDS_VACANCY'"),
    )
    key = [*batch, "college_code", "branch_code", "counselling_round", "category_code", "academic_year"]
    rows = rows.withColumn("anomalies", F.expr("CAST(array() AS ARRAY<STRING>)"))
    return _finish(rows, early, numeric, late, key, batch).drop("_college", "_branch")


def validate_fees(
    rows: DataFrame, colleges: DataFrame, branches: DataFrame, batch: Sequence[str] = ()
) -> DataFrame:
    """Rules for fee rows; amounts may come as text."""
    fields = ("total_fee", "tuition_fee", "other_fee")
    rows = _registered(rows, colleges, "college_code", "_college")
    rows = _registered(rows, branches, "branch_code", "_branch")
    rows = rows.withColumns(columns({f"_{c}": f"try_cast({c} AS DECIMAL(20,4))" for c in fields}))
    early = case(
        (_blank("college_code"), "'MISSING_COLLEGE_CODE'"),
        ("total_fee IS NULL", "'MISSING_TOTAL_FEE'"),
        ("_college IS NULL", "'UNKNOWN_COLLEGE_CODE'"),
        (f"NOT {_blank('branch_code')} AND _branch IS NULL", "'UNKNOWN_BRANCH_CODE'"),
    )
    numeric = [
        f"CASE WHEN {c} IS NOT NULL AND _{c} IS NULL THEN 'NON_NUMERIC_{c.upper()}' "
        f"WHEN _{c} < 0 THEN 'INVALID_{c.upper()}' END"
        for c in fields
    ]
    late = case(
        ("_tuition_fee > _total_fee", "'TUITION_EXCEEDS_TOTAL_FEE'"),
        ("_other_fee > _total_fee", "'OTHER_FEE_EXCEEDS_TOTAL_FEE'"),
        (f"abs(_tuition_fee + _other_fee - _total_fee) > {FEE_TOLERANCE}", "'FEE_COMPONENTS_MISMATCH'"),
    )
    key = [*batch, "college_code", "branch_code", "academic_year"]
    rows = rows.withColumn("anomalies", F.expr("CAST(array() AS ARRAY<STRING>)"))
    return _finish(rows, early, numeric, late, key, batch).drop("_college", "_branch", *[f"_{c}" for c in fields])


def valid_rows(tagged: DataFrame) -> DataFrame:
    """The rows to publish, in the state PUBLISHED."""
    return tagged.filter("is_valid").drop("error_codes", "anomalies", "is_valid").withColumn(
        "status", F.lit("PUBLISHED")
    )


def error_rows(tagged: DataFrame, entity_type: str) -> DataFrame:
    """One row per error or remark, with its severity and the record as JSON."""
    inner = [c for c in tagged.columns if c not in ("error_codes", "anomalies", "is_valid")]
    name = f"coalesce(row_identifier, concat({text(entity_type.lower())}, '_rec_', row_idx))"
    found = (
        "concat(transform(error_codes, c -> named_struct('error_code', c, 'severity', 'ERROR')), "
        "transform(anomalies, c -> named_struct('error_code', c, 'severity', 'WARNING')))"
    )
    return tagged.selectExpr(
        f"{text(entity_type)} AS entity_type",
        f"{name} AS entity_identifier",
        "row_idx",
        f"to_json(struct({', '.join(inner)})) AS context_data",
        f"inline({found})",
    )


# documents --------------------------------------------------------------------


def thresholds_frame(spark, overrides: Mapping[tuple[str, str], int] | None = None) -> DataFrame:
    """Fewest rows per (document type, program) as a table; ``overrides`` replaces or adds entries."""
    table = {**COMPLETENESS, **(overrides or {})}
    rows = ", ".join(f"({text(d)}, {text(p)}, {n})" for (d, p), n in table.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(document_type, program_type, minimum_rows)")


def completeness_gate(documents: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Hold back documents with suspiciously few rows; ``error_code`` is NULL for the others.

    ``documents``: document_type, program_type, extracted_count, baseline_count
    and minimum (NULL for the table's). ``is_corrigendum`` skips the gate.
    """
    known = thresholds.selectExpr(
        "document_type AS _type", "program_type AS _prog", "minimum_rows AS _minimum"
    )
    program = "upper(coalesce(program_type, 'ENGINEERING'))"
    joined = documents.withColumn("_program", F.expr(program)).join(
        known, F.expr("document_type = _type AND _program = _prog"), "left"
    )
    default = case(("_program = 'ARCHITECTURE'", str(DEFAULT_MINIMUM["ARCHITECTURE"])),
                   default=str(DEFAULT_MINIMUM["ENGINEERING"]))
    needed = f"coalesce(minimum, _minimum, {default})"
    dynamic = f"CAST(floor(baseline_count * {BASELINE_SHARE}D) AS BIGINT)"
    error = case(
        ("is_corrigendum", "NULL"),
        ("document_type IS NULL OR document_type IN ('', 'UNKNOWN', 'OTHER')", "'UNKNOWN_DOCUMENT_TYPE'"),
        (f"document_type NOT IN {texts(sorted({d for d, _ in COMPLETENESS}))}", "NULL"),
        ("extracted_count <= 0", "'SUSPICIOUS_LOW_COUNT'"),
        (
            f"document_type = 'CUTOFF_PDF' AND _program = 'ENGINEERING' AND baseline_count > {BASELINE_MINIMUM} "
            f"AND extracted_count < {dynamic}",
            "'SUSPICIOUS_LOW_COUNT'",
        ),
        (f"extracted_count < {needed}", "'SUSPICIOUS_LOW_COUNT'"),
    )
    return joined.withColumns(columns({"minimum_rows": needed, "error_code": error})).drop(
        "_type", "_prog", "_minimum", "_program"
    )


def corrigendum(*texts_of: str) -> str:
    """SQL text: one of the texts, such as title and address, says the document corrects another."""
    return " OR ".join(f"contains(lower(coalesce({t}, '')), 'corrigendum')" for t in texts_of)


# remarks on a document as a whole; they hold nothing back
DOCUMENT_ANOMALY = case(
    ("NOT is_usable_text", "'SCANNED_OR_EMPTY_PDF'"),
    (
        "extracted_count = 0 AND NOT contains(document_type, 'HTML') AND NOT contains(document_type, 'NOTIFICATION')",
        "'SUSPICIOUSLY_EMPTY_DOCUMENT'",
    ),
)


def document_outcomes(
    tagged: DataFrame, documents: DataFrame, thresholds: DataFrame, baseline: DataFrame | None = None
) -> DataFrame:
    """Status of each document from its rows: how many passed, and whether it may publish.

    ``tagged`` are validated rows with ``source_version_id``. One bad seat or fee
    row holds the whole document back; of a cutoff document the good rows may
    still publish if enough of them are left. A document without any row is kept.

    ``baseline`` has the published rows per (academic_year, round_code, program_type), as ``publish.published_counts``
    gives them; documents then need academic_year and counselling_round, and take ``baseline_count`` from there. If
    documents have ``is_usable_text``, a remark on the document as a whole is added as ``document_anomaly``.
    """
    counts = tagged.groupBy("source_version_id").agg(
        F.expr("count(1) AS _rows"),
        F.expr("count_if(is_valid) AS _valid"),
        F.expr("coalesce(bool_and(branch_code IN ('AT', 'AR')) FILTER (WHERE is_valid), false) AS _arch"),
    )
    joined = documents.join(counts, "source_version_id", "left").withColumns(
        columns(
            {
                "candidate_records": "coalesce(_rows, 0L)",
                "extracted_count": "coalesce(_valid, 0L)",
                "program_type": "CASE WHEN _arch THEN 'ARCHITECTURE' ELSE program_type END",
                "rejected_records": "coalesce(_rows, 0L) - coalesce(_valid, 0L)",
            }
        )
    ).drop("_rows", "_valid", "_arch")
    if baseline is not None:
        held = baseline.selectExpr("academic_year", "round_code AS counselling_round", "program_type", "baseline_count")
        joined = lookup(joined.drop("baseline_count"), held, ["academic_year", "counselling_round", "program_type"])
    gated = completeness_gate(joined, thresholds)
    if "is_usable_text" in documents.columns:
        gated = gated.withColumn("document_anomaly", F.expr(DOCUMENT_ANOMALY))
    strict = "document_type IN ('SEAT_MATRIX_PDF', 'VACANT_SEATS_PDF', 'FEE_STRUCTURE_PDF')"
    reason = case(
        (f"{strict} AND rejected_records > 0", "'VALIDATION_FAILED'"), ("error_code IS NOT NULL", "error_code")
    )
    return gated.withColumn("failure_reason", F.expr(reason)).withColumn(
        "processing_status", F.expr("CASE WHEN failure_reason IS NULL THEN 'PUBLISHED' ELSE 'NEEDS_REVIEW' END")
    )


def publishable_rows(tagged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Valid rows of documents that may publish; one document may hold most of the rows."""
    passed = outcomes.filter("failure_reason IS NULL").select("source_version_id").distinct()
    return lookup(valid_rows(tagged), passed.withColumn("_passed", F.lit(True)), ["source_version_id"], "inner").drop(
        "_passed"
    )


# stored facts -----------------------------------------------------------------


def audit(
    colleges: DataFrame, branches: DataFrame, cutoffs: DataFrame, seats: DataFrame, fees: DataFrame
) -> DataFrame:
    """Static checks of the store as (check, violations) rows; each table is read once."""

    def counts(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
        one = df.agg(*[F.expr(f"count_if({test}) AS {name}") for name, test in checks.items()])
        cells = ", ".join(f"named_struct('check', '{n}', 'violations', {n})" for n in checks)
        return one.selectExpr(f"inline(array({cells}))")

    def duplicates(df: DataFrame, name: str, key: Sequence[str]) -> DataFrame:
        groups = df.groupBy(*key).agg(F.expr("count(1) AS _n")).filter("_n > 1")
        return groups.agg(F.expr("count(1) AS violations")).selectExpr(f"'{name}' AS check", "violations")

    def suspicious(code: str, name: str, code_pattern: str, name_pattern: str) -> str:
        return (
            f"{code} RLIKE {text(code_pattern)} OR {name} RLIKE {text(name_pattern)} OR {code} IS NULL "
            f"OR {name} IS NULL OR trim({code}) = '' OR trim({name}) = ''"
        )

    parts = [
        counts(
            colleges,
            {
                "college_suspicious": suspicious(
                    "college_code", "college_name", SUSPICIOUS_COLLEGE_CODE, SUSPICIOUS_COLLEGE_NAME),
                "college_placeholder": f"college_code RLIKE {text(PLACEHOLDER)} OR college_name RLIKE {text(PLACEHOLDER)}",
            },
        ),
        counts(
            branches,
            {
                "branch_suspicious": suspicious(
                    "branch_code", "branch_name", SUSPICIOUS_BRANCH_CODE, SUSPICIOUS_BRANCH_NAME),
                "branch_placeholder": f"branch_code RLIKE {text(PLACEHOLDER)} OR branch_name RLIKE {text(PLACEHOLDER)}",
            },
        ),
        counts(
            cutoffs,
            {
                "cutoff_opening_above_closing": "opening_rank > closing_rank",
                "cutoff_not_positive": "closing_rank <= 0",
                "cutoff_missing_key": "college_id IS NULL OR branch_id IS NULL OR category_code IS NULL "
                "OR round_code IS NULL",
            },
        ),
        counts(
            seats,
            {
                "seat_negative": "total_seats < 0 OR vacant_seats < 0",
                "seat_vacant_above_total": "vacant_seats > total_seats",
                "seat_missing_key": "college_id IS NULL OR branch_id IS NULL",
            },
        ),
        counts(fees, {"fee_negative": "total_fee < 0", "fee_zero": "total_fee = 0"}),
        duplicates(colleges, "college_duplicate_code", ["college_code"]),
        duplicates(branches, "branch_duplicate_code", ["branch_code"]),
        duplicates(
            cutoffs, "cutoff_duplicate_key",
            ["college_id", "branch_id", "category_code", "round_code", "academic_year"],
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphans(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Facts whose key is not in the dimension."""
    return facts.join(dimension.select(key), key, "left_anti")
