"""Walk-forward backtests of simple forecasts, without leakage.

A target year is tested against the years before it and nothing else. All
target years, programs and categories are one plan: each wide row yields one
case per target year in which the combo has a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions import stats
from cutline.functions.ranks import at_least_one, nonzero, rounded
from cutline.functions.sql import columns, inline, text
from cutline.plans.history import as_of
from cutline.plans.panel import COMBO, WidePanel
from cutline.plans.pooled import lookup, with_medians
from cutline.sources.workdir import kept

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

POINT_MODELS = {
    "lag1": "Baseline A (Lag-1 Latest)",
    "median": "Baseline B (Historical Median)",
    "mean": "Baseline C (Historical Mean)",
    "recency": "Recency Weighted (70/30)",
    "trend": "Baseline E (Linear Trend)",
}
INTERVAL_MODELS = {
    "range": "Empirical [Min, Max] Range",
    "mad": "Median +- 1.5 * MAD",
    "lag25": "Lag-1 +- 25% Width",
    "lag35": "Lag-1 +- 35% Width",
}
RECENCY_WEIGHTS = (0.7, 0.3)
MAD_WIDTH = 1.5
MAD_FALLBACK = 0.15
MIN_CORRELATION_SAMPLE = 10

# ---------------------------------------------------------------------------

WINDOW = ["target_year", "program_type", "category"]


def cases(wide: WidePanel, target_years: Sequence[int], scope: str = "R1") -> DataFrame:
    """One row per combo and target year with a value: the actual rank and the summary of its past."""
    years = wide.calendar.years
    past = [f"_p{y}" for y in years]
    rows = [
        {
            "target_year": str(target),
            "actual": f"CAST({wide.scope_rank(target, scope)} AS DOUBLE)",
            **{
                f"_p{y}": f"CAST({wide.scope_rank(y, scope) if y < target else 'NULL'} AS DOUBLE)"
                for y in years
            },
        }
        for target in target_years
        if target in years
    ]
    year_of = [f"CASE WHEN _p{y} IS NOT NULL THEN {y} END" for y in years]
    found = wide.long(COMBO, rows).filter("actual IS NOT NULL").withColumns(
        columns(
            {
                "depth": stats.count_of(past),
                "latest": stats.latest_of(past),
                "latest_year": stats.latest_of(year_of),
            }
        )
    )
    found = found.withColumns(
        columns(
            {
                "second": stats.latest_of([f"CASE WHEN latest_year > {y} THEN _p{y} END" for y in years]),
                "second_year": stats.latest_of(
                    [f"CASE WHEN latest_year > {y} AND _p{y} IS NOT NULL THEN {y} END" for y in years]
                ),
                "mean": stats.mean_of(past, "depth"),
                "median": stats.median_of(past, "depth"),
                "lowest": stats.min_of(past),
                "highest": stats.max_of(past),
            }
        )
    )
    return found.withColumn("mad", F.expr(stats.mad_of(past, "depth", "median"))).drop(*past)


def open_cases(
    cells: DataFrame, year: str = "academic_year", target_years: Sequence[int] | None = None, record: str | None = None
) -> DataFrame:
    """As ``cases``, over all years that the cells hold, whatever a calendar says of them.

    ``cells`` are long rows (combo, year, closing_rank); of several in one year the greatest rank counts. The history
    of each case is read as of its year. Medians need the values themselves: an array per combo with one value per
    year of the table. With ``record``, the column of record ids, ``sources`` lists the records a case learned from.
    """
    ranks = cells.selectExpr(
        *COMBO, f"{year} AS _year", "CAST(closing_rank AS BIGINT) AS actual", f"{record or 'CAST(NULL AS STRING)'} AS _record"
    ).where("_year IS NOT NULL AND actual IS NOT NULL")
    best = "max(struct(actual, _record))" if record else "struct(max(actual) AS actual, CAST(NULL AS STRING) AS _record)"
    # read three times, by different columns: Spark would join and group all lines anew for each of them
    ranks = kept(ranks.groupBy(*COMBO, "_year").agg(F.expr(f"{best} AS _best")).select(*COMBO, "_year", "_best.*"), "ranks")
    keys = ["college_id", "branch_id", "program_type", "category"]
    targets = ranks if target_years is None else ranks.where(F.col("_year").isin(list(target_years)))
    known = as_of(targets, ranks, keys, "_year", "_year", "actual")
    all_ranks = ranks.groupBy(*keys).agg(F.expr("collect_list(struct(_year AS y, actual AS v, _record AS r)) AS _all"))
    sources = ["transform(_earlier, x -> x.r) AS sources"] if record else []
    return (
        known.join(all_ranks, keys)
        .withColumn("_earlier", F.expr("filter(_all, x -> x.y < _year)"))
        .withColumn("_past", F.expr("array_sort(transform(_earlier, x -> CAST(x.v AS DOUBLE)))"))
        .withColumn("median", F.expr(_middle("_past")))
        .withColumn("_off", F.expr("array_sort(transform(_past, v -> abs(v - median)))"))
        .selectExpr(
            *COMBO, "CAST(_year AS INT) AS target_year", "CAST(actual AS DOUBLE) AS actual", "CAST(depth AS INT) AS depth",
            "CAST(latest AS DOUBLE) AS latest", "CAST(latest_at AS INT) AS latest_year", "CAST(second AS DOUBLE) AS second",
            "CAST(second_at AS INT) AS second_year", "CAST(total AS DOUBLE) / nullif(depth, 0) AS mean", "median",
            "CAST(lowest AS DOUBLE) AS lowest", "CAST(highest AS DOUBLE) AS highest", f"{_middle('_off')} AS mad", *sources,
        )
    )


def _middle(values: str) -> str:
    """Median of a sorted array; NULL of an empty one."""
    size = f"size({values})"
    return (
        f"CASE WHEN {size} > 0 THEN ({values}[({size} - 1) DIV 2] + {values}[{size} DIV 2]) / 2 END"
    )


def window_summary(tested: DataFrame) -> DataFrame:
    """Combos tested, evaluated and without any history, per window."""
    return tested.groupBy(*WINDOW).agg(
        F.count(F.lit(1)).alias("total_test_combinations"),
        F.count_if(F.col("depth") > 0).alias("evaluated_combinations"),
        F.count_if(F.col("depth") == 0).alias("cold_start_combinations"),
    )


_CASE = [*WINDOW, "college_id", "branch_id", "depth", "actual"]


def point_forecasts(tested: DataFrame) -> DataFrame:
    """Long rows (case, model, actual, forecast) of all evaluated cases."""
    major, minor = RECENCY_WEIGHTS
    trend = at_least_one("latest + (latest - second) / (latest_year - second_year) * (target_year - latest_year)")
    forecasts = {
        "lag1": "latest",
        "median": "median",
        "mean": "mean",
        "recency": f"CASE WHEN depth > 1 THEN latest * {major}D + second * {minor}D ELSE latest END",
        "trend": f"CASE WHEN depth > 1 THEN {trend} ELSE latest END",
    }
    rows = [{"model": text(POINT_MODELS[k]), "forecast": v} for k, v in forecasts.items()]
    return tested.filter("depth > 0").selectExpr(*_CASE, inline(rows))


def interval_forecasts(tested: DataFrame) -> DataFrame:
    """Long rows (case, model, actual, low, high) of all evaluated cases."""
    middle = f"coalesce({nonzero('median')}, latest)"
    reach = f"coalesce({nonzero('mad')}, latest * {MAD_FALLBACK}D) * {MAD_WIDTH}D"
    bounds = {
        "range": ("lowest", "highest"),
        "mad": (at_least_one(f"{middle} - {reach}"), f"{middle} + {reach}"),
        "lag25": (at_least_one("latest * 0.75D"), "latest * 1.25D"),
        "lag35": (at_least_one("latest * 0.65D"), "latest * 1.35D"),
    }
    rows = [{"model": text(INTERVAL_MODELS[k]), "low": lo, "high": hi} for k, (lo, hi) in bounds.items()]
    return tested.filter("depth > 0").selectExpr(*_CASE, inline(rows))


def point_metrics(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAE, MedAE, RMSE and MdAPE (positive actuals only)."""
    error = "abs(actual - forecast)"
    out = with_medians(
        forecasts,
        keys,
        [
            "count(1) AS sample_size",
            f"avg({error}) AS mae",
            "sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse",
        ],
        {"med_ae": error, "mdape": f"CASE WHEN actual > 0 THEN {error} / actual END"},
    )
    digits = {"mae": 2, "med_ae": 2, "rmse": 2, "mdape": 4}
    return out.selectExpr(*keys, "sample_size", *[f"{rounded(c, d)} AS {c}" for c, d in digits.items()])


def interval_metrics(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage, widths, and the shares of actuals below and above the interval."""
    width = "greatest(0D, high - low)"
    inside = "(low <= actual AND actual <= high)"

    def share(test: str, name: str) -> str:
        return f"avg(CASE WHEN {test} THEN 1D ELSE 0D END) AS {name}"

    out = with_medians(
        forecasts,
        keys,
        [
            "count(1) AS sample_size",
            share(inside, "coverage"),
            f"avg({width}) AS mean_width",
            share(f"NOT {inside} AND actual < low", "below_lower_rate"),
            share(f"NOT {inside} AND actual >= low", "above_upper_rate"),
        ],
        {"median_width": width, "median_rel_width": f"CASE WHEN actual > 0 THEN {width} / actual END"},
    )
    digits = {"coverage": 4, "median_width": 1, "mean_width": 1, "median_rel_width": 4,
              "below_lower_rate": 4, "above_upper_rate": 4}
    return out.selectExpr(
        *keys, "sample_size", *[f"{rounded(f'coalesce({c}, 0D)', d)} AS {c}" for c, d in digits.items()]
    )


def depth_breakdown(forecasts: DataFrame) -> DataFrame:
    """Lag-1 errors by number of earlier years."""
    lag1 = forecasts.filter(F.col("model") == POINT_MODELS["lag1"])
    return point_metrics(lag1, [*WINDOW, "depth"])


def leakage_violations(train: DataFrame, target_years: Sequence[int], round_code: str = "R1") -> DataFrame:
    """Counts of training rows that must not be there; every count has to be 0.

    ``train`` has one row per training record and target year it was used for.
    """
    kept = train.filter(F.col("target_year").isin(list(target_years)))
    return kept.groupBy("target_year").agg(
        F.count(F.lit(1)).alias("train_records"),
        F.count_if(F.col("academic_year") >= F.col("target_year")).alias("future_records"),
        F.count_if(F.col("round_code") != round_code).alias("other_rounds"),
        F.count_if(F.col("status") != "PUBLISHED").alias("unpublished_records"),
    )


def training_rows(panel: DataFrame, target_years: Sequence[int], round_code: str = "R1") -> DataFrame:
    """The records a backtest of each target year may learn from."""
    targets = F.array(*[F.lit(t) for t in target_years])
    return (
        panel.filter((F.col("round_code") == round_code) & (F.col("status") == "PUBLISHED"))
        .withColumn("target_year", F.explode(targets))
        .filter(F.col("academic_year") < F.col("target_year"))
    )


def leakage_by_lineage(tested: DataFrame, facts: DataFrame, round_code: str = "R1") -> DataFrame:
    """Counts per target year of the records that cases (with ``sources``) did learn from, checked against the facts.

    Year, round and status are those the facts hold under the record's id, not those the cases were built with; so a
    record of a later year that slipped into a history under a wrong year is found. All but the first count have to be 0.
    """
    used = tested.selectExpr("target_year", "explode(sources) AS record_id")
    known = facts.selectExpr("record_id", "academic_year AS _year", "round_code AS _round", "status AS _status")
    return lookup(used, known, ["record_id"]).groupBy("target_year").agg(
        F.count(F.lit(1)).alias("train_records"),
        F.expr("count_if(_year IS NULL) AS unknown_records"),
        F.expr("count_if(_year >= target_year) AS future_records"),
        F.expr(f"count_if(_round <> {text(round_code)}) AS other_rounds"),
        F.expr("count_if(_status <> 'PUBLISHED') AS unpublished_records"),
    )


def seat_correlation(
    wide: WidePanel, seats: DataFrame, branches: DataFrame, target: int, base: int, round_code: str = "R1",
) -> DataFrame:
    """Does the number of seats go along with forecast error or with rank? One row.

    Seats are taken on the canonical branch, published only, the largest
    value per combo and year; fewer than ten pairs say INSUFFICIENT_DATA.
    """
    canon = branches.selectExpr("branch_id", "coalesce(canonical_branch_id, branch_id) AS _canonical")
    held = (
        seats.filter("status = 'PUBLISHED' AND total_seats IS NOT NULL")
        .join(canon, "branch_id")
        .groupBy("college_id", F.expr("_canonical AS branch_id"))
        .agg(
            F.expr(f"max(CASE WHEN academic_year = {target} THEN total_seats END) AS _now"),
            F.expr(f"max(CASE WHEN academic_year = {base} THEN total_seats END) AS _then"),
        )
        .selectExpr("college_id", "branch_id", f"coalesce({nonzero('_now')}, _then) AS seats")
    )
    pairs = (
        wide.where("ENGINEERING", "GM")
        .frame.selectExpr(
            "college_id",
            "branch_id",
            f"CAST({wide.rank(target, round_code)} AS DOUBLE) AS now",
            f"CAST({wide.rank(base, round_code)} AS DOUBLE) AS then",
        )
        .filter("now IS NOT NULL AND then IS NOT NULL")
        .join(held.filter("seats IS NOT NULL"), ["college_id", "branch_id"])
    )
    measured = pairs.agg(
        F.expr("count(1) AS sample_size"),
        F.expr("corr(CAST(seats AS DOUBLE), abs(now - then)) AS _error"),
        F.expr("corr(CAST(seats AS DOUBLE), now) AS _rank"),
    )
    enough = f"sample_size >= {MIN_CORRELATION_SAMPLE}"

    def value(c: str) -> str:
        return f"CASE WHEN {enough} THEN {rounded(f'coalesce(nanvl({c}, 0D), 0D)', 4)} END"

    return measured.selectExpr(
        "sample_size",
        value("_error") + " AS correlation_seats_to_prediction_error",
        value("_rank") + " AS correlation_seats_to_closing_rank",
        f"CASE WHEN {enough} THEN 'NEGLIGIBLE_PREDICTIVE_SIGNAL' ELSE 'INSUFFICIENT_DATA' END AS assessment",
    )
