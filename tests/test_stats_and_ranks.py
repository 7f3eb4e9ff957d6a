import pytest

from cutline.functions import ranks, stats
from cutline.plans.calendar import ADMISSIONS
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "values, mean, median, sd, cv, mad",
    [
        ([100], 100, 100, None, None, None),
        ([100, 200], 150, 150, 70.7107, 0.4714, 50),
        ([100, 150, 200], 150, 150, 50, 0.3333, 50),
        ([0, 0], 0, 0, 0, None, 0),
    ],
)
def test_statistics(spark, values, mean, median, sd, cv, mad):
    xs = [str(v) for v in values] + ["CAST(NULL AS INT)"] * 2
    row = spark.range(1).selectExpr(stats.count_of(xs) + " AS n").selectExpr(
        "n", stats.mean_of(xs, "n") + " AS mean", stats.median_of(xs, "n") + " AS median"
    ).selectExpr("*", stats.sample_sd_of(xs, "n", "mean") + " AS sd", stats.mad_of(xs, "n", "median") + " AS mad")
    row = row.selectExpr("*", stats.cv_of("mean", "sd") + " AS cv").first()

    def close(found, expected):
        return found is None if expected is None else found == pytest.approx(expected, abs=1e-4)

    assert row.n == len(values)
    for found, expected in zip((row.mean, row.median, row.sd, row.cv, row.mad), (mean, median, sd, cv, mad)):
        assert close(found, expected)


@pytest.mark.parametrize(
    "y1, r1, y2, r2, status",
    [
        (2023, "R1", 2026, "R1", "DIRECT"),
        (2023, "MOCK", 2024, "MOCK", "DIRECT"),
        (2024, "R3", 2026, "R3", "PARTIAL"),
        (2023, "R3", 2024, "R3", "DIRECT"),
        (2023, "CONSOLIDATED_FINAL", 2024, "R3", "PARTIAL"),
        (2023, "R2_PHASE2", 2024, "R2_PHASE2", "DIRECT"),
        (2023, "R2_PHASE2", 2026, "R2_PHASE2", "NONE"),
        (2025, "R4", 2026, "R4", "PARTIAL"),
        (2023, "KKR_SPECIAL", 2023, "R1", "NONE"),
        (2023, "KKR_SPECIAL", 2026, "KKR_SPECIAL", "DIRECT"),
        (2025, "R4", 2024, "R1", "NONE"),
    ],
)
def test_comparability(one, y1, r1, y2, r2, status):
    assert ADMISSIONS.compare(y1, r1, y2, r2) == status
    column = ADMISSIONS.comparability(F.lit(y1), F.lit(r1), F.lit(y2), F.lit(r2))
    assert one(column) == status


@pytest.mark.parametrize(
    "rank, state",
    [
        (10000, "NUMERICALLY_BELOW_LOWER_BOUND"),
        (15000, "WITHIN_LOWER_HALF"),
        (21000, "WITHIN_LOWER_HALF"),
        (21001, "WITHIN_UPPER_HALF"),
        (30000, "WITHIN_UPPER_HALF"),
        (30001, "NUMERICALLY_ABOVE_UPPER_BOUND"),
    ],
)
def test_decision_edges(one, rank, state):
    assert one(ranks.decision_state(str(rank), "15000D", "21000D", "30000D")) == state


@pytest.mark.parametrize(
    "kind, p, lower, upper",
    [
        ("VOLATILITY_ADAPTIVE_WIDE", 9000, 8100, 13000),
        ("VOLATILITY_ADAPTIVE_WIDE", 10000, 8500, 22000),
        ("VOLATILITY_ADAPTIVE_WIDE", 25000, 17500, 70000),
        ("VOLATILITY_ADAPTIVE_WIDE", 100000, 70000, 120000),
        ("ASYMMETRIC_RELATIVE_EMPIRICAL", 1000, 850, 1550),
        ("ADDITIVE_EMPIRICAL", 3000, 1, 23000),
        ("SYMMETRIC_RELATIVE", 1000, 750, 1250),
    ],
)
def test_intervals(one, kind, p, lower, upper):
    low, high = ranks.interval_bounds(f"{p}D", kind)
    found = one(ranks.interval(f"({low})", f"({high})", f"{p}D", kind))
    assert (found.lower_bound, found.upper_bound) == (lower, upper)
    assert found.interval_width == upper - lower and found.target_coverage == ranks.COVERAGE[kind]


def test_containment_wording(one):
    assert one(ranks.containment("23510", "26313")["label"]) == "Within by 2,803"
    assert one(ranks.containment("23510", "18906")["label"]) == "Beyond by 4,604"


def test_numbers(one):
    assert one(ranks.rounded("2.345D", 2)) == 2.35
    assert one(ranks.relative_move("0", "5")) == 0.0
    assert one(ranks.in_lakhs("1234567")) == "12.35"
    assert one(ranks.signed_thousands("1500")) == "+1,500"
    assert one(ranks.hours_between("TIMESTAMP'2024-01-02 12:00:00'", "TIMESTAMP'2024-01-01'")) == 36
    assert one(ranks.evidence_strength("2", "false")) == "MODERATE"
    assert one(ranks.evidence_strength("0", "true")) == "STRONG"
