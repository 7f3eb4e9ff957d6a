"""Batch prediction of closing ranks: request rows in, result rows out.

All requests are scored in one plan. A request meets one wide row that holds
the history of its combo; every baseline model is an expression on that row,
and the model asked for is picked by ``when``. Rounds share the code: what
differs is which series counts as history (Round 1, Round 3 or the final
state) and which earlier round of the same year may be used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import stats
from cutline.functions.ranks import (
    INTERVAL_TYPES,
    containment,
    decision_state,
    evidence_strength,
    interval,
    interval_bounds,
    relative_move,
    rounded,
    thousands,
)
from cutline.functions.sql import case, columns, once, struct, text, texts
from cutline.plans.calendar import RoundCalendar
from cutline.plans.panel import NO_RANK, WidePanel, canonical_branches
from cutline.plans.pooled import lookup, pooled_medians

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

MODEL_A = "MODEL_A_LATEST_HISTORICAL"
MODEL_B = "MODEL_B_PREVIOUS_YEAR"
MODEL_C = "MODEL_C_HISTORICAL_MEAN"
MODEL_D = "MODEL_D_HISTORICAL_MEDIAN"
MODEL_E = "MODEL_E_RECENT_MEDIAN"
MODEL_F = "MODEL_F_PRECEDING_ROUND"
MODEL_G1 = "MODEL_G1_ADDITIVE_MOVEMENT"
MODEL_G2 = "MODEL_G2_MULTIPLICATIVE_MOVEMENT"
MODEL_H = "MODEL_H_HYBRID"
MODELS = [MODEL_A, MODEL_B, MODEL_C, MODEL_D, MODEL_E, MODEL_F, MODEL_G1, MODEL_G2, MODEL_H]

PROGRAMS = ["ENGINEERING", "ARCHITECTURE"]
CATEGORIES = ["GM", "KKR"]
ROUNDS = ["R1", "R3", "R4", "TERMINAL"]
SECOND_ROUND_NAMES = ["R2", "ROUND_2", "ROUND 2", "ROUND2"]
ARCHITECTURE_ROUNDS = ["R1", "TERMINAL"]
TERMINAL_SHIFT = 3800.0
HYBRID_WEIGHTS = (0.7, 0.3)

MODEL_NAMES = {
    "R1": {
        MODEL_A: "Model A (Latest Historical R1 - %s)",
        MODEL_B: "Model B (Previous Year %s R1)",
        MODEL_C: "Model C (Historical Mean R1)",
        MODEL_D: "Model D (Historical Median R1)",
        MODEL_E: "Model E (Recent 2-Year Median R1)",
    },
    "R3": {
        MODEL_A: "Model A (Latest Historical R3 - %s)",
        MODEL_F: "Model F (Within-Year Preceding R1 Alone)",
        MODEL_G1: "Model G1 (Preceding R1 + Additive Movement [+%s ranks])",
        MODEL_G2: "Model G2 (Preceding R1 * [1 + %.1f%% Relative Movement])",
        MODEL_H: "Model H (Hybrid: 70% Intra-Year Movement + 30% Historical R3)",
    },
    "TERMINAL": {
        MODEL_A: "Model A (Latest Historical Terminal - %s)",
        MODEL_B: "Model B (Strict Previous Year %s Terminal)",
        MODEL_C: "Model C (Historical Mean Terminal)",
        MODEL_D: "Model D (Historical Median Terminal)",
        MODEL_F: "Model F (Within-Year Preceding R3 Alone)",
        MODEL_G1: "Model G1 (Preceding R3 + Additive Expansion [+3,800 ranks])",
        MODEL_H: "Model H (Hybrid: 70% Preceding R3 + 30% Historical Median Terminal)",
    },
}
EVIDENCE_TEXT = {
    "R1": "Round 1 official published closing rank",
    "R3": "Round 3 official closing rank",
    "TERMINAL": "terminal official closing rank",
    "preceding": "%d %s preceding closing rank: %s",
    "movement": "Median R1->R3 expansion learned from prior years: +%s ranks",
}
FAIL_CLOSED = "FAIL_CLOSED_HANDLER"
NO_HISTORY = "NO_HISTORICAL_RECORDS"
MODEL_VERSION = "v1.0-research"
FEATURE_VERSION = "v1.0"

# ---------------------------------------------------------------------------


def validate_requests(
    requests: DataFrame, colleges: DataFrame, branches: DataFrame, base_year: int = 2023
) -> DataFrame:
    """Resolve each request and name the first rule it breaks in ``error_code`` (NULL if none).

    The branch becomes its canonical branch; program, category and round are upper-cased.
    """
    known = colleges.selectExpr("college_id", "true AS _college")
    canon = canonical_branches(branches).selectExpr(
        "raw_branch_id", "branch_id AS _canonical", "program_type AS _program"
    )
    own = branches.selectExpr("branch_id AS raw_branch_id", "program_type AS branch_program")
    error = case(
        ("_college IS NULL", "'UNKNOWN_COLLEGE'"),
        ("_canonical IS NULL", "'UNKNOWN_BRANCH'"),
        (f"program_type IS NULL OR program_type NOT IN {texts(PROGRAMS)}", "'UNSUPPORTED_PROGRAM'"),
        ("_program <> program_type", "'PROGRAM_MISMATCH'"),
        (f"category IS NULL OR category NOT IN {texts(CATEGORIES)}", "'UNSUPPORTED_CATEGORY'"),
        (f"round IN {texts(SECOND_ROUND_NAMES)}", "'UNSUPPORTED_ROUND_R2'"),
        ("round = 'KKR_SPECIAL'", "'SPECIAL_ROUND'"),
        (f"round IS NULL OR round NOT IN {texts(ROUNDS)}", "'UNSUPPORTED_ROUND'"),
        (
            f"program_type = 'ARCHITECTURE' AND round NOT IN {texts(ARCHITECTURE_ROUNDS)}",
            "'ROUND_NOT_APPLICABLE'",
        ),
        (f"academic_year < {base_year}", "'YEAR_BEFORE_BASELINE'"),
    )
    asked = requests.withColumnRenamed("branch_id", "raw_branch_id").withColumns(
        columns({c: f"upper({c})" for c in ("program_type", "category", "round")})
    )
    return (
        asked.join(known, "college_id", "left")
        .join(canon, "raw_branch_id", "left")
        .join(own, "raw_branch_id", "left")
        .withColumns(columns({"error_code": error, "branch_id": "coalesce(_canonical, raw_branch_id)"}))
        .drop("_college", "_canonical", "_program")
    )


ERROR_CLASS = case(
    ("error_code IN ('UNKNOWN_COLLEGE', 'UNKNOWN_BRANCH')", "'NOT_FOUND'"), ("error_code IS NOT NULL", "'INVALID'")
)


def learned_movement(
    wide: WidePanel, target_years: Sequence[int], first: str = "R1", second: str = "R3"
) -> DataFrame:
    """Median move between two rounds over all combos and all years before each target year.

    One row per (target year, program, category): the calendar bounds its size.
    """
    moves = [
        {"academic_year": str(target), "_from": wide.rank(year, first), "_to": wide.rank(year, second)}
        for target in target_years
        for year in wide.calendar.years
        if year < target and {(year, first), (year, second)} <= set(wide.calendar.slots)
    ]
    nothing = [{"academic_year": "0", "_from": NO_RANK, "_to": NO_RANK}]
    long = wide.long(["program_type", "category"], moves or nothing).filter(
        "_from IS NOT NULL AND _to IS NOT NULL"
    )
    return pooled_medians(
        long,
        ["academic_year", "program_type", "category"],
        {"median_move": "_to - _from", "median_relative_move": relative_move("_from", "_to")},
    )


def _by_round(r1: str, r3: str, terminal: str) -> str:
    return case(("_family = 'R1'", r1), ("_family = 'R3'", r3), default=terminal)


def _add_history(requests: DataFrame, wide: WidePanel) -> DataFrame:
    """History, preceding round, and its summary for every request."""
    years = wide.calendar.years
    keys = ["college_id", "branch_id", "category", "program_type"]
    family = F.expr("CASE WHEN round = 'R4' THEN 'TERMINAL' ELSE round END")
    held = lookup(
        requests.withColumn("_family", family), wide.frame.drop("college_code", "branch_code"), keys
    )

    def at_target(code: str) -> str:
        return case(*[(f"academic_year = {y}", wide.rank(y, code)) for y in years])

    past = [f"_p{y}" for y in years]
    series = {
        f"_p{y}": f"CAST(CASE WHEN academic_year > {y} THEN "
        f"{_by_round(wide.rank(y, 'R1'), wide.rank(y, 'R3'), wide.final_rank(y))} END AS DOUBLE)"
        for y in years
    }
    preceding = f"CAST({_by_round('NULL', at_target('R1'), at_target('R3'))} AS DOUBLE)"
    slots = [c for c in wide.frame.columns if c not in (*keys, "college_code", "branch_code")]
    held = once(held, {**series, "_preceding": preceding}).drop(*slots)
    held = once(
        held,
        {
            "_n": stats.count_of(past),
            "_latest": stats.latest_of(past),
            "_latest_year": stats.latest_of([f"CASE WHEN _p{y} IS NOT NULL THEN {y} END" for y in years]),
        },
    )
    return once(
        held,
        {
            "_second": stats.latest_of([f"CASE WHEN _latest_year > {y} THEN _p{y} END" for y in years]),
            "_previous": case(*[(f"academic_year - 1 = {y}", f"_p{y}") for y in years]),
            "_mean": stats.mean_of(past, "_n"),
            "_median": stats.median_of(past, "_n"),
        },
    )


def _model() -> str:
    """The model that is really used, given the one asked for and what is known."""
    within = texts([MODEL_F, MODEL_G1, MODEL_G2, MODEL_H])
    asked = f"coalesce(model_type, {text(MODEL_G1)})"
    return _by_round(
        case((f"model_type IN {texts([MODEL_B, MODEL_C, MODEL_D, MODEL_E])}", "model_type"), default=text(MODEL_A)),
        case(
            (f"_preceding IS NULL OR {asked} NOT IN {within}", text(MODEL_A)),
            (f"{asked} = {text(MODEL_H)} AND _n = 0", text(MODEL_G1)),
            default=asked,
        ),
        case(
            (f"_preceding IS NOT NULL AND model_type = {text(MODEL_G1)}", text(MODEL_G1)),
            (f"_preceding IS NOT NULL AND model_type = {text(MODEL_H)} AND _n > 0", text(MODEL_H)),
            ("_preceding IS NOT NULL", text(MODEL_F)),
            (f"model_type IN {texts([MODEL_A, MODEL_B, MODEL_C])}", "model_type"),
            default=text(MODEL_D),
        ),
    )


def _estimate() -> str:
    major, minor = HYBRID_WEIGHTS
    recent = "CASE WHEN _n > 1 THEN (_latest + _second) / 2 ELSE _latest END"
    shift = f"CASE WHEN _family = 'R3' THEN _move ELSE {TERMINAL_SHIFT}D END"
    hybrid = (
        f"CASE WHEN _family = 'R3' THEN (_preceding + _move) * {major}D + _latest * {minor}D "
        f"ELSE _preceding * {major}D + _median * {minor}D END"
    )
    values = {
        MODEL_A: "_latest",
        MODEL_B: "_previous",
        MODEL_C: "_mean",
        MODEL_D: "_median",
        MODEL_E: recent,
        MODEL_F: "_preceding",
        MODEL_G1: f"_preceding + {shift}",
        MODEL_G2: "_preceding * (1 + _relative_move)",
        MODEL_H: hybrid,
    }
    return case(*[(f"_model = {text(m)}", v) for m, v in values.items()])


def _model_name() -> str:
    arguments = {
        ("R1", MODEL_A): "_latest_year",
        ("R1", MODEL_B): "academic_year - 1",
        ("R3", MODEL_A): "_latest_year",
        ("R3", MODEL_G1): thousands("_move"),
        ("R3", MODEL_G2): "_relative_move * 100",
        ("TERMINAL", MODEL_A): "_latest_year",
        ("TERMINAL", MODEL_B): "academic_year - 1",
    }

    def name(family: str, model: str, words: str) -> str:
        argument = arguments.get((family, model))
        return f"format_string({text(words)}, {argument})" if argument else text(words)

    return _by_round(
        *[
            case(*[(f"_model = {text(m)}", name(family, m, words)) for m, words in MODEL_NAMES[family].items()])
            for family in ("R1", "R3", "TERMINAL")
        ]
    )


def _failure() -> str:
    """Why nothing can be predicted; NULL if something can."""

    def words(sentence: str, argument: str = "academic_year") -> str:
        return f"format_string({text(sentence)}, {argument})"

    nothing = _by_round(
        words("No published Round 1 cutoffs of this combination before year %d."),
        words("Neither Round 1 of %d nor an earlier Round 3 of this combination exists."),
        words("Neither Round 3 of %d nor an earlier final cutoff of this combination exists."),
    )
    return case(
        ("_n = 0 AND _preceding IS NULL", nothing),
        (
            f"_model = {text(MODEL_B)} AND _previous IS NULL",
            words("Model B requires strict T-1 data, which academic year %d lacks.", "academic_year - 1"),
        ),
        (
            f"_family = 'R3' AND _model = {text(MODEL_A)} AND _n = 0",
            words("Round 1 of %d may not be used by this model and no earlier Round 3 exists."),
        ),
    )


def _evidence(calendar: RoundCalendar) -> str:
    """Ordered array of what the prediction rests on; as long as the calendar at most."""

    def item(kind: str, year: str, code: str, rank: str, weight: str, words: str) -> str:
        return struct(
            {
                "source_type": text(kind),
                "academic_year": f"CAST({year} AS INT)",
                "round_code": code,
                "closing_rank": f"CAST({rank} AS DOUBLE)",
                "weight": f"CAST({weight} AS DOUBLE)",
                "description": words,
            }
        )

    within = (
        "(_preceding IS NOT NULL AND (_family = 'TERMINAL' OR "
        f"_model IN {texts([MODEL_F, MODEL_G1, MODEL_G2, MODEL_H])}))"
    )
    before = _by_round("''", "'Round 1'", "'Round 3'")
    wording = _by_round(*[text(EVIDENCE_TEXT[family]) for family in ("R1", "R3", "TERMINAL")])
    items = [
        case(
            (
                within,
                item(
                    "PRECEDING_ROUND", "academic_year", _by_round("NULL", "'R1'", "'R3'"), "_preceding", "NULL",
                    f"format_string({text(EVIDENCE_TEXT['preceding'])}, academic_year, {before}, "
                    f"{thousands('_preceding')})",
                ),
            )
        ),
        case(
            (
                f"{within} AND _family = 'R3' AND _model = {text(MODEL_G1)}",
                item(
                    "HISTORICAL_MOVEMENT", "NULL", "'R1_TO_R3'", "_move", "NULL",
                    f"format_string({text(EVIDENCE_TEXT['movement'])}, {thousands('_move')})",
                ),
            )
        ),
    ]
    default = f"coalesce(model_type, {text(MODEL_A)}) = {text(MODEL_A)}"
    for y in calendar.years:
        latest = f"_latest_year = {y}"
        items.append(
            case(
                (
                    f"NOT {within} AND _p{y} IS NOT NULL AND (_family <> 'R3' OR {latest})",
                    item(
                        "HISTORICAL_CUTOFF", str(y), "_family", f"_p{y}",
                        case((f"_family = 'R1' AND {latest} AND {default}", "1D")),
                        f"format_string('%d %s: %s', {y}, {wording}, {thousands(f'_p{y}')})",
                    ),
                )
            )
        )
    return f"array_compact(array({', '.join(items)}))"


def _explanation(calendar: RoundCalendar) -> str:
    """What a result was made of, a line for each kind of evidence that the row holds."""
    years = ", ".join(f"CASE WHEN _p{y} IS NOT NULL THEN '{y}' END" for y in calendar.years)
    seen = f"array_join(array_compact(array({years})), ', ')"
    series = _by_round("'R1'", "'R3'", "'final round'")
    before = _by_round("''", "'R1'", "'R3'")

    def line(pattern: str, *arguments: str) -> str:
        return f"format_string({text(pattern)}, {', '.join(arguments)})"

    lines = [
        case(("_n > 0", line("history of %s: %s (newest %s)", series, seen, thousands("_latest"))),
             default=line("history of %s: none before %d", series, "academic_year")),
        case(("_preceding IS NOT NULL", line("%s in %d: %s", before, "academic_year", thousands("_preceding")))),
        case(("_preceding IS NOT NULL AND _family = 'R3'", line("median move from R1 to R3: %s", thousands("_move")))),
        line("%s: %s within %s and %s", "_name", thousands("_estimate"), thousands("_interval.lower_bound"),
             thousands("_interval.upper_bound")),
    ]
    return f"array_compact(array({', '.join(lines)}))"


def score_requests(
    valid: DataFrame,
    wide: WidePanel,
    target_years: Sequence[int] | None = None,
    dataset_version: str = "v1",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Predict each valid request, or say why not (status INSUFFICIENT_EVIDENCE).

    ``target_years`` are the years requests may ask for; by default those of
    the calendar and the year after it. ``carry`` names columns to pass through.
    """
    cal = wide.calendar
    targets = list(target_years or [*cal.years, cal.years[-1] + 1])
    # bounded by (target years x programs x categories), a few dozen rows
    moves = F.broadcast(learned_movement(wide, targets))
    rows = _add_history(valid, wide).join(moves, ["academic_year", "program_type", "category"], "left")
    rows = once(
        rows,
        {
            "_move": "coalesce(median_move, 0D)",
            "_relative_move": "coalesce(median_relative_move, 0D)",
            "_model": _model(),
        },
    )
    rows = once(rows, {"_failure": _failure()})
    rows = once(rows, {"_estimate": f"CASE WHEN _failure IS NULL THEN {_estimate()} END"})
    wide_type, narrow_type = "VOLATILITY_ADAPTIVE_WIDE", "ASYMMETRIC_RELATIVE_EMPIRICAL"
    (wide_low, wide_high), (low, high) = (interval_bounds("_estimate", t) for t in (wide_type, narrow_type))
    terminal = "_family = 'TERMINAL'"
    rows = once(
        rows, {"_lower": case((terminal, wide_low), default=low), "_upper": case((terminal, wide_high), default=high)}
    )
    rows = once(
        rows,
        {
            "_interval": case(
                (terminal, interval("_lower", "_upper", "_estimate", wide_type)),
                default=interval("_lower", "_upper", "_estimate", narrow_type),
            )
        },
    ).withColumn("_name", F.expr(case(("_failure IS NULL", _model_name()), default=text(FAIL_CLOSED))))

    def if_ok(value: str, otherwise: str = "NULL") -> str:
        return case(("_failure IS NULL", value), default=otherwise)

    return rows.selectExpr(
        "request_id",
        "college_id",
        "raw_branch_id",
        "branch_id",
        "academic_year",
        "category",
        "program_type",
        f"CASE WHEN _failure IS NULL AND {terminal} THEN 'TERMINAL' ELSE round END AS round",
        if_ok("'SUCCESS'", "'INSUFFICIENT_EVIDENCE'") + " AS status",
        rounded("_estimate", 1) + " AS predicted_closing_rank",
        "_interval AS prediction_interval",
        "_interval.lower_bound AS lower_bound",
        "_interval.upper_bound AS upper_bound",
        if_ok(evidence_strength("_n", "_preceding IS NOT NULL"), "'INSUFFICIENT_EVIDENCE'") + " AS evidence_strength",
        if_ok("_n + CAST(_preceding IS NOT NULL AS INT)", "0") + " AS observation_count",
        if_ok("coalesce(_latest_year, academic_year)") + " AS latest_comparable_year",
        if_ok("'NONE'", text(NO_HISTORY)) + " AS cold_start_reason",
        "_name AS model_name",
        f"{text(MODEL_VERSION)} AS model_version",
        f"{text(dataset_version)} AS dataset_version",
        f"{text(FEATURE_VERSION)} AS feature_definition_version",
        f"filter({_evidence(cal)}, x -> _failure IS NULL) AS evidence_trail",
        if_ok(_explanation(cal), "array(_failure)") + " AS explanation",
        "model_type",
        "candidate_rank",
        *carry,
    )


def predict(
    requests: DataFrame,
    wide: WidePanel,
    colleges: DataFrame,
    branches: DataFrame,
    base_year: int = 2023,
) -> DataFrame:
    """Predictions of all valid requests; ``validate_requests`` lists the refused ones."""
    checked = validate_requests(requests, colleges, branches, base_year)
    return score_requests(checked.filter("error_code IS NULL"), wide)


def decide(
    requests: DataFrame,
    wide: WidePanel,
    colleges: DataFrame,
    branches: DataFrame,
    base_year: int = 2023,
) -> DataFrame:
    """Place each candidate's rank against the predicted interval.

    Refused requests keep a row with ``error_code``. Requests for ARCHITECTURE
    have no calibrated boundary: once their college, branch and program are
    found right, the answer is INSUFFICIENT_EVIDENCE.
    """
    as_r4 = F.expr("CASE WHEN upper(trim(round)) = 'TERMINAL' THEN 'R4' ELSE upper(trim(round)) END")
    checked = validate_requests(requests.withColumn("round", as_r4), colleges, branches, base_year)
    architecture = "program_type <=> 'ARCHITECTURE'"
    decision_error = case(
        ("candidate_rank IS NULL OR candidate_rank <= 0", "'INVALID_CANDIDATE_RANK'"),
        ("program_type NOT IN ('ENGINEERING', 'ARCHITECTURE')", "'UNSUPPORTED_PROGRAM'"),
        (f"{architecture} AND error_code IN ('UNKNOWN_COLLEGE', 'UNKNOWN_BRANCH')", "error_code"),
        (f"{architecture} AND branch_program <> 'ARCHITECTURE'", "'PROGRAM_MISMATCH'"),
        (f"NOT ({architecture})", "error_code"),
    )
    scored = score_requests(
        checked.withColumns(columns({"_refused": decision_error, "_no_boundary": architecture, "_asked": "round"})),
        wide,
        carry=["_refused", "_no_boundary", "_asked"],
    )
    # refused rows go through the same plan; what was computed for them is hidden here
    answer, given = "_refused IS NULL AND NOT _no_boundary", "_refused IS NULL"

    def shown(value: str, without: str = "NULL") -> str:
        return case((answer, value), (given, without))

    state = decision_state("candidate_rank", "lower_bound", "predicted_closing_rank", "upper_bound")
    no_boundary = "array('There is no calibrated decision boundary for ARCHITECTURE programs.')"
    return scored.selectExpr(
        "request_id", "college_id", "branch_id", "academic_year", "category", "program_type", "candidate_rank",
        "_asked AS round",
        shown("status", "'INSUFFICIENT_EVIDENCE'") + " AS prediction_status",
        shown("predicted_closing_rank") + " AS predicted_closing_rank",
        shown("lower_bound") + " AS lower_bound",
        shown("upper_bound") + " AS upper_bound",
        shown(state, "'INSUFFICIENT_EVIDENCE'") + " AS evidence_state",
        shown("evidence_strength", "'INSUFFICIENT_EVIDENCE'") + " AS evidence_strength",
        shown("observation_count", "0") + " AS observation_count",
        shown("model_name", text(FAIL_CLOSED)) + " AS model_name",
        shown("explanation", no_boundary) + " AS explanation",
        "_refused AS error_code",
    ).withColumn("decision_text", F.expr(_DECISION_TEXT))


def _decision_text() -> str:
    """One sentence on where the rank lies; it never speaks of a guarantee."""
    rank, low, mid, high = (
        thousands(c) for c in ("candidate_rank", "lower_bound", "predicted_closing_rank", "upper_bound")
    )
    said = {
        "NUMERICALLY_BELOW_LOWER_BOUND": (
            "Rank %s is below the lower bound of the estimated range (%s - %s).", (rank, low, high)),
        "WITHIN_LOWER_HALF": ("Rank %s lies between the lower bound %s and the estimate %s.", (rank, low, mid)),
        "WITHIN_UPPER_HALF": ("Rank %s lies between the estimate %s and the upper bound %s.", (rank, mid, high)),
        "NUMERICALLY_ABOVE_UPPER_BOUND": (
            "Rank %s is beyond the upper bound of the estimated range (%s - %s).", (rank, low, high)),
        "INSUFFICIENT_EVIDENCE": ("There is not enough comparable evidence.", ()),
    }
    return case(
        *[
            (f"evidence_state = {text(state)}", f"format_string({', '.join([text(words), *args])})")
            for state, (words, args) in said.items()
        ]
    )


_DECISION_TEXT = _decision_text()


def score_choices(candidates: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each candidate's rank against the prediction of each of their choices, and its containment.

    ``predictions`` holds one row per choice.
    """
    keys = ["college_id", "branch_id", "category", "academic_year", "round"]
    known = predictions.select(*keys, "predicted_closing_rank", "lower_bound", "upper_bound")
    state = decision_state("candidate_rank", "lower_bound", "predicted_closing_rank", "upper_bound")
    within = containment("candidate_rank", "predicted_closing_rank")
    return lookup(candidates, known, keys).selectExpr(
        "*", f"{state} AS evidence_state", *[f"{v} AS {n}" for n, v in within.items()]
    )


def all_intervals(predictions: DataFrame) -> DataFrame:
    """Every calibration rule applied to each prediction, one row per rule."""
    known = predictions.filter("predicted_closing_rank IS NOT NULL")
    rules = []
    for rule in INTERVAL_TYPES:
        lower, upper = interval_bounds("predicted_closing_rank", rule)
        rules.append(interval(f"({lower})", f"({upper})", "predicted_closing_rank", rule))
    return known.selectExpr("request_id", "predicted_closing_rank", f"inline(array({', '.join(rules)}))")
