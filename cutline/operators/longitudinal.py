"""Longitudinal analytics over the panel: coverage, movement, volatility, progression, anomalies.

Operators that compare slots of one combo take the wide panel, so a year pair
or a round pair is an expression and not a self-join. All programs and
categories are answered in one plan; filter the wide panel for one of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import stats
from cutline.functions.ranks import data_quality, direction, nonzero, relative_distance, relative_move
from cutline.functions.sql import case, inline, text
from cutline.functions.sql import columns as sql_columns
from cutline.plans.calendar import NONE, STRICT_SCOPE, TERMINAL_SCOPES, RoundCalendar
from cutline.plans.panel import COMBO, NO_RANK, WidePanel
from cutline.plans.pooled import with_medians

PARTITION = ["program_type", "category"]

# Wording of the anomaly rows
NOT_DETERMINABLE = "NOT_DETERMINABLE_FROM_AVAILABLE_DATA"
VALIDATION_FAILURE = "DATA_VALIDATION_FAILURE"
SUPERSEDED_REASON = (
    "Historical record status is SUPERSEDED (non-published). Preserved in database "
    "for source provenance and immutability."
)


# coverage -------------------------------------------------------------------


def coverage_counts(panel: DataFrame) -> DataFrame:
    """Record counts at several grains of a panel that holds every status.

    The facts are counted once at the finest grain, so the grouping sets
    expand a few hundred rows and not the facts.
    """
    fine = panel.groupBy("academic_year", "round_code", "category", "program_type").agg(
        F.expr("count(1) AS total"), F.expr("count_if(status = 'PUBLISHED') AS published")
    )
    year, code, cat, prog = (F.col(c) for c in ("academic_year", "round_code", "category", "program_type"))
    grain = case(
        ("_g = 15", "'ALL'"), ("_g = 7", "'YEAR'"), ("_g = 3", "'YEAR_ROUND'"), ("_g = 13", "'CATEGORY'"),
        default="'PROGRAM'",
    )
    return (
        fine.groupingSets([[], [year], [year, code], [cat], [prog]], year, code, cat, prog)
        .agg(
            F.grouping_id().alias("_g"),
            F.expr("sum(total) AS total_records"),
            F.expr("sum(published) AS published_records"),
        )
        .selectExpr(
            f"{grain} AS grain", "academic_year", "round_code", "category", "program_type",
            "total_records", "published_records", "total_records - published_records AS superseded_records",
        )
    )


def coverage_entities(panel: DataFrame) -> DataFrame:
    """Distinct colleges and branches per year of a published panel."""
    return panel.groupBy("academic_year").agg(
        F.count_distinct("college_id").alias("colleges"), F.count_distinct("branch_id").alias("branches")
    )


def observed_years(panel: DataFrame) -> DataFrame:
    """Per combo the sorted set of years with a record; the set is as long as the calendar."""
    return panel.groupBy(*COMBO).agg(F.sort_array(F.collect_set("academic_year")).alias("years_observed"))


def observation_depth(panel: DataFrame) -> DataFrame:
    """How many combos have 1, 2, 3 ... observed years, by program and in all (program NULL)."""
    counts = (
        observed_years(panel)
        .groupBy("program_type", F.size("years_observed").alias("depth"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counts.groupingSets(
        [[F.col("depth")], [F.col("depth"), F.col("program_type")]], F.col("depth"), F.col("program_type")
    ).agg(F.sum("_n").alias("combinations"))


def year_patterns(panel: DataFrame) -> DataFrame:
    """How many combos were observed in exactly this set of years."""
    pattern = F.array_join(F.col("years_observed").cast("array<string>"), ",")
    return observed_years(panel).groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("combinations"))


def excluded_records(cutoffs: DataFrame, colleges: DataFrame, branches: DataFrame) -> DataFrame:
    """Records outside the published panel, on their own branch, with the reason."""
    return (
        cutoffs.filter(F.col("status") != "PUBLISHED")
        .join(colleges.select("college_id", "college_code", "college_name"), "college_id")
        .join(branches.select("branch_id", "branch_code", "program_type"), "branch_id")
        .select(
            "record_id", "academic_year", "college_code", "college_name", "branch_code", "program_type",
            F.col("category_code").alias("category"), "round_code", "status", "closing_rank",
            "source_version_id", F.lit(SUPERSEDED_REASON).alias("exclusion_reason"),
        )
    )


# movement -------------------------------------------------------------------


def yoy_items(wide: WidePanel, pairs: Sequence[tuple[int, int]], scope: str = "R1") -> DataFrame:
    """Movement of each combo between two years, for each comparable pair of years."""
    cal = wide.calendar
    rows = []
    for first, second in pairs:
        if first >= second:
            raise ValueError(f"from_year ({first}) must be before to_year ({second})")
        round1, round2 = cal.round_in_scope(first, scope), cal.round_in_scope(second, scope)
        status = cal.compare(first, round1, second, round2)
        if status == NONE:
            continue
        rows.append(
            {
                "from_year": str(first),
                "from_round": text(round1),
                "from_rank": wide.rank(first, round1),
                "to_year": str(second),
                "to_round": text(round2),
                "to_rank": wide.rank(second, round2),
                "comparability": text(status),
            }
        )
    if not rows:  # no comparable pair: an empty result of the same shape
        rows = [
            {"from_year": "0", "from_round": "''", "from_rank": NO_RANK, "to_year": "0", "to_round": "''",
             "to_rank": NO_RANK, "comparability": text(NONE)}
        ]
    found = wide.long(COMBO, rows).filter("from_rank IS NOT NULL AND to_rank IS NOT NULL")
    return found.selectExpr(
        "*",
        "concat_ws('->', from_year, to_year) AS transition",
        "to_rank - from_rank AS absolute_movement",
        relative_move("from_rank", "to_rank") + " AS relative_movement",
        direction("(to_rank - from_rank)") + " AS direction",
    )


_MOVEMENT = [
    "count(1) AS matched_pairs",
    "avg(absolute_movement) AS mean_absolute_movement",
    "avg(relative_movement) AS mean_relative_movement",
    "count_if(absolute_movement < 0) AS earlier_count",
    "count_if(absolute_movement > 0) AS later_count",
    "count_if(absolute_movement = 0) AS unchanged_count",
]
_MOVEMENT_MEDIANS = {
    "median_absolute_movement": "absolute_movement",
    "median_relative_movement": "relative_movement",
}


def yoy_aggregate(items: DataFrame) -> DataFrame:
    keys = ["from_year", "to_year", "from_round", "to_round", *PARTITION, "comparability"]
    return with_medians(items, keys, _MOVEMENT, _MOVEMENT_MEDIANS)


def progression_items(wide: WidePanel, years: Sequence[int] | None = None) -> DataFrame:
    """Movement of each combo between successive rounds of one year."""
    cal = wide.calendar
    rows = [
        {
            "academic_year": str(year),
            "from_round": text(first),
            "to_round": text(second),
            "from_rank": wide.rank(year, first),
            "to_rank": wide.rank(year, second),
        }
        for year in (years or cal.years)
        for first, second in cal.progressions.get(year, [])
    ]
    found = wide.long(COMBO, rows).filter("from_rank IS NOT NULL AND to_rank IS NOT NULL")
    return found.selectExpr(
        "*",
        "to_rank - from_rank AS absolute_movement",
        relative_move("from_rank", "to_rank") + " AS relative_movement",
    )


def round_progression(wide: WidePanel, years: Sequence[int] | None = None) -> DataFrame:
    keys = ["academic_year", "from_round", "to_round", *PARTITION]
    return with_medians(progression_items(wide, years), keys, _MOVEMENT, _MOVEMENT_MEDIANS)


def recency_evidence(wide: WidePanel, anchor_year: int, scope: str = "R1") -> DataFrame:
    """Is the more recent earlier year closer to the anchor year than the older one?"""
    cal = wide.calendar
    family = "TERMINAL" if scope in TERMINAL_SCOPES or scope == STRICT_SCOPE else scope
    known = cal.recency.get(family)
    recent, older = known or (anchor_year, anchor_year)
    slots = {n: wide.rank(y, cal.round_in_scope(y, scope))
             for n, y in (("anchor", anchor_year), ("near", recent), ("far", older))}
    triples = wide.frame.selectExpr(*PARTITION, *[f"{v} AS {n}" for n, v in slots.items()]).filter(
        "anchor IS NOT NULL AND near IS NOT NULL AND far IS NOT NULL" if known else "false"
    )
    out = with_medians(
        triples,
        PARTITION,
        [
            "count(1) AS evaluated_triples",
            "count_if(abs(anchor - near) < abs(anchor - far)) AS recent_closer_count",
            "count_if(abs(anchor - near) > abs(anchor - far)) AS older_closer_count",
            "count_if(abs(anchor - near) = abs(anchor - far)) AS equal_distance_count",
        ],
        {
            "recent_median_absolute_distance": "abs(anchor - near)",
            "older_median_absolute_distance": "abs(anchor - far)",
            "recent_median_relative_distance": relative_distance("near", "anchor"),
            "older_median_relative_distance": relative_distance("far", "anchor"),
        },
    )
    return out.selectExpr(
        f"{anchor_year} AS anchor_year",
        f"{recent} AS recent_year",
        f"{older} AS older_year",
        f"{text(scope)} AS comparison_round",
        "*",
        "recent_closer_count / evaluated_triples * 100 AS recent_closer_percentage",
    )


# volatility -----------------------------------------------------------------


def volatility_metrics(wide: WidePanel, scope: str = "TERMINAL", min_n: int = 1) -> DataFrame:
    """Spread of each combo's closing rank over the observed years."""
    years = wide.calendar.years
    cols = [f"y{y}" for y in years]
    n, mean, median, sd = "observation_count", "mean", "median", "standard_deviation"
    # for each year after the first: rank of the previous observed year, and rank
    moves = [(stats.latest_of(cols[:i]), cols[i]) for i in range(1, len(cols))]
    both = [f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {relative_move(a, b)} END" for a, b in moves]
    # each step uses columns of the step before, which keeps the expressions short
    return (
        wide.frame.selectExpr(*COMBO, *[f"{wide.scope_rank(y, scope)} AS y{y}" for y in years])
        .withColumn(n, F.expr(stats.count_of(cols)))
        .filter(f"{n} >= {max(min_n, 1)}")
        .withColumns(sql_columns({mean: stats.mean_of(cols, n), median: stats.median_of(cols, n)}))
        .withColumn(sd, F.expr(stats.sample_sd_of(cols, n, mean)))
        .selectExpr(
            *COMBO,
            f"{text(scope)} AS round_scope",
            n,
            stats.values_array([f"CASE WHEN y{y} IS NOT NULL THEN {y} END" for y in years]) + " AS years_observed",
            stats.values_array([f"CASE WHEN y{y} IS NULL THEN {y} END" for y in years]) + " AS missing_years",
            mean,
            median,
            sd,
            stats.cv_of(mean, sd) + " AS coefficient_of_variation",
            stats.mad_of(cols, n, median) + " AS mad",
            stats.min_of(cols) + " AS min_rank",
            stats.max_of(cols) + " AS max_rank",
            f"{stats.max_of(cols)} - {stats.min_of(cols)} AS rank_range",
            stats.values_array([f"{b} - {a}" for a, b in moves]) + " AS sequential_absolute_movements",
            stats.values_array(both) + " AS sequential_relative_movements",
            data_quality(n) + " AS volatility_data_quality",
        )
    )


def volatility_by_n(wide: WidePanel, scope: str = "TERMINAL") -> DataFrame:
    """Volatility by number of observed years; moves are pooled over combos."""
    metrics = volatility_metrics(wide, scope, min_n=2)
    keys = [*PARTITION, "observation_count"]
    per_combo = with_medians(
        metrics,
        keys,
        [
            "count(1) AS combination_count",
            "avg(coefficient_of_variation) AS mean_cv",
            "min(coefficient_of_variation) AS min_cv",
            "max(coefficient_of_variation) AS max_cv",
        ],
        {"median_cv": "coefficient_of_variation"},
    )
    moves = metrics.selectExpr(
        *keys, "inline(arrays_zip(sequential_absolute_movements, sequential_relative_movements))"
    )
    pooled = with_medians(
        moves,
        keys,
        ["count(1) AS move_count"],
        {
            "median_absolute_movement": "abs(sequential_absolute_movements)",
            "median_relative_movement": "abs(sequential_relative_movements)",
        },
    )
    return per_combo.join(pooled, keys, "left").withColumn(
        "volatility_data_quality", F.expr(data_quality("observation_count"))
    )


def sparsity(panel: DataFrame, calendar: RoundCalendar) -> DataFrame:
    """Depth and gaps of each combo's observed years."""
    reference = f"array({', '.join(map(str, calendar.years))})"
    return observed_years(panel).selectExpr(
        *COMBO,
        "size(years_observed) AS observation_count",
        "years_observed",
        f"array_except({reference}, years_observed) AS missing_years",
        "size(filter(years_observed, y -> array_contains(years_observed, y + 1))) AS consecutive_transition_count",
        "array_max(years_observed) AS latest_observation_year",
        "size(years_observed) < 3 AS is_sparse",
    )


# anomalies ------------------------------------------------------------------


_ANOMALY = (
    "anomaly_type string, academic_year int, college_code string, branch_code string, program_type string, "
    "category string, from_round string, to_round string, from_rank int, to_rank int, rank_delta int, "
    "direction string, cause string, description string"
)


def _anomaly(rows: DataFrame, **values: str) -> DataFrame:
    """Rows in the common shape; fields that are not given are NULL."""
    fields = [f.split(" ") for f in _ANOMALY.split(", ")]
    return rows.selectExpr(*[f"CAST({values.get(n, 'NULL')} AS {t}) AS {n}" for n, t in fields])


def backward_movements(wide: WidePanel) -> DataFrame:
    """A later round that closed at a smaller rank than the round before it."""
    items = progression_items(wide).filter(
        "absolute_movement < 0 AND program_type IN ('ENGINEERING', 'ARCHITECTURE') AND category IN ('GM', 'KKR')"
    )
    same = ["academic_year", "college_code", "branch_code", "program_type", "category", "from_round",
            "to_round", "from_rank", "to_rank"]
    return _anomaly(
        items,
        **{c: c for c in same},
        anomaly_type="'BACKWARD_ROUND_MOVEMENT'",
        rank_delta="absolute_movement",
        direction="'EARLIER_NUMERICALLY'",
        cause=text(NOT_DETERMINABLE),
        description="'Observed closing rank decreased numerically between rounds.'",
    )


def invalid_ranks(panel: DataFrame) -> DataFrame:
    """Non-positive closing ranks, and opening ranks above the closing rank (opening 0 is missing)."""
    findings = (
        "array_compact(array("
        "CASE WHEN closing_rank <= 0 THEN named_struct('shown', CAST(NULL AS INT), "
        "'words', 'Closing rank must be strictly positive.') END, "
        "CASE WHEN nullif(opening_rank, 0) > closing_rank THEN named_struct('shown', opening_rank, "
        "'words', 'Opening rank exceeds closing rank.') END))"
    )
    same = ["academic_year", "college_code", "branch_code", "program_type", "category"]
    return _anomaly(
        panel.selectExpr(*same, "round_code", "closing_rank", f"inline({findings})"),
        **{c: c for c in same},
        anomaly_type="'INVALID_RANK_VALUE'",
        from_round="round_code",
        from_rank="shown",
        to_rank="closing_rank",
        cause=text(VALIDATION_FAILURE),
        description="words",
    )


def missing_provenance(panel: DataFrame) -> DataFrame:
    return _anomaly(
        panel.filter("source_version_id IS NULL"),
        **{c: c for c in ("academic_year", "college_code", "branch_code")},
        anomaly_type="'MISSING_PROVENANCE'",
        cause=text(VALIDATION_FAILURE),
        description="'Missing source version linkage.'",
    )


def anomalies(panel: DataFrame, wide: WidePanel) -> DataFrame:
    return backward_movements(wide).unionByName(invalid_ranks(panel)).unionByName(missing_provenance(panel))


def anomaly_details(found: DataFrame) -> DataFrame:
    """Add the sentence that spells a finding out."""
    words = (
        F.when(
            F.col("anomaly_type") == "BACKWARD_ROUND_MOVEMENT",
            F.format_string(
                "Observed closing rank decreased numerically from %d in %s to %d in %s (delta: %d). "
                "Direction: EARLIER_NUMERICALLY. Cause: " + NOT_DETERMINABLE + ".",
                "from_rank", "from_round", "to_rank", "to_round", "rank_delta",
            ),
        )
        .when(F.col("anomaly_type") == "MISSING_PROVENANCE", "Cutoff record has null source_version_id")
        .when(F.col("from_rank").isNull(), F.format_string("Non-positive closing rank: %d", "to_rank"))
        .otherwise(
            F.format_string("Opening rank (%d) greater than closing rank (%d)", "from_rank", "to_rank")
        )
    )
    return found.withColumn("details", words)


# shapes for reading ----------------------------------------------------------


def progression_matrix(wide: WidePanel) -> DataFrame:
    """Year by round table of one choice; the final column takes R4, else the consolidated list."""
    rows = [
        {
            "academic_year": str(y),
            "round_1": wide.rank(y, "R1"),
            "round_2": f"CASE WHEN category = 'KKR' THEN {wide.rank(y, 'KKR_SPECIAL')} "
            f"ELSE {wide.rank(y, 'R2_PHASE2')} END",
            "round_3": wide.rank(y, "R3"),
            "final": f"coalesce({nonzero(wide.rank(y, 'R4'))}, {wide.rank(y, 'CONSOLIDATED_FINAL')})",
        }
        for y in wide.calendar.years
    ]
    return wide.long(COMBO, rows).filter(
        "coalesce(nullif(round_1, 0), nullif(round_2, 0), nullif(round_3, 0), nullif(final, 0)) IS NOT NULL"
    )


def _slots_of(wide: WidePanel, year: int) -> tuple[list[str], list[str]]:
    codes = [code for y, code in wide.calendar.slots if y == year]
    return codes, [wide.rank(year, code) for code in codes]


def round_ladder(wide: WidePanel) -> DataFrame:
    """Rounds of each combo and year in order, with the step from the round published before."""
    rows = []
    for year in wide.calendar.years:
        codes, ranks = _slots_of(wide, year)
        for i, code in enumerate(codes):
            before = stats.latest_of(ranks[:i]) if i else NO_RANK
            rows.append(
                {
                    "academic_year": str(year),
                    "round_code": text(code),
                    "position": str(i),
                    "closing_rank": ranks[i],
                    "delta": f"{ranks[i]} - {before}",
                }
            )
    step = case(("delta > 0", "'expansion'"), ("delta < 0", "'contraction'"), ("delta = 0", "'Unchanged'"))
    return wide.long(COMBO, rows).filter("closing_rank IS NOT NULL").withColumn("step", F.expr(step))


def highest_round(wide: WidePanel) -> DataFrame:
    """The last published round of each combo and year."""
    rows = []
    for year in wide.calendar.years:
        codes, ranks = _slots_of(wide, year)
        last = stats.latest_of([f"CASE WHEN {r} IS NOT NULL THEN {text(c)} END" for c, r in zip(codes, ranks)])
        rows.append({"academic_year": str(year), "round_code": last, "closing_rank": stats.latest_of(ranks)})
    return wide.long(COMBO, rows).filter("closing_rank IS NOT NULL")


def college_boundary(panel: DataFrame, ranks: DataFrame) -> DataFrame:
    """Lowest closing rank of each college, and whether a candidate's rank lies inside it.

    ``ranks`` has one row per (college_id, candidate_rank) to answer.
    """
    lowest = panel.groupBy("college_id").agg(F.min("closing_rank").alias("lowest_cutoff"))
    return ranks.join(lowest, "college_id", "left").withColumn(
        "within_boundary", F.col("candidate_rank") <= F.col("lowest_cutoff")
    )


# report ---------------------------------------------------------------------


def report(
    panel: DataFrame,
    wide: WidePanel,
    yoy_pairs: Sequence[tuple[int, int]],
    anchor_year: int,
    program_type: str = "ENGINEERING",
    category: str = "GM",
) -> DataFrame:
    """All analyses as long rows (section, item, measure, value)."""
    one = wide.where(program_type, category)
    published = panel.filter(F.col("status") == "PUBLISHED")

    def melt(df: DataFrame, section: str, item: str, measures: Sequence[str]) -> DataFrame:
        cells = [{"measure": text(m), "value": f"CAST({m} AS DOUBLE)"} for m in measures]
        return df.selectExpr(f"{text(section)} AS section", f"{item} AS item", inline(cells))

    moves = [
        "matched_pairs", "median_absolute_movement", "mean_absolute_movement",
        "median_relative_movement", "mean_relative_movement",
        "earlier_count", "later_count", "unchanged_count",
    ]
    parts = [
        melt(
            coverage_counts(panel),
            "coverage",
            "concat_ws(':', grain, academic_year, round_code, category, program_type)",
            ["total_records", "published_records", "superseded_records"],
        ),
        melt(observation_depth(published), "depth", "concat_ws(':', depth, program_type)", ["combinations"]),
        melt(year_patterns(published), "pattern", "pattern", ["combinations"]),
        melt(
            volatility_by_n(one),
            "volatility_by_n",
            "CAST(observation_count AS STRING)",
            ["combination_count", "median_cv", "mean_cv", "min_cv", "max_cv",
             "median_absolute_movement", "median_relative_movement"],
        ),
        melt(round_progression(one), "progression", "concat_ws(':', academic_year, from_round, to_round)", moves),
        melt(yoy_aggregate(yoy_items(one, yoy_pairs)), "yoy", "concat_ws('->', from_year, to_year)", moves),
        melt(
            recency_evidence(one, anchor_year),
            "recency",
            "CAST(anchor_year AS STRING)",
            ["evaluated_triples", "recent_closer_count", "older_closer_count", "equal_distance_count",
             "recent_closer_percentage", "recent_median_absolute_distance",
             "older_median_absolute_distance", "recent_median_relative_distance",
             "older_median_relative_distance"],
        ),
        melt(
            anomalies(published, wide).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("found")),
            "anomalies", "anomaly_type", ["found"],
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
