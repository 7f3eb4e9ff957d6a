"""Rank arithmetic: moves, intervals, evidence, rounding, formatting.

Arguments and results are SQL text; ``sql.expr`` turns a result into a Column.
"""

from __future__ import annotations

from cutline.functions.sql import case, struct, text

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# interval type -> target coverage
COVERAGE = {
    "VOLATILITY_ADAPTIVE_WIDE": 0.90,
    "ASYMMETRIC_RELATIVE_EMPIRICAL": 0.70,
    "ADDITIVE_EMPIRICAL": 0.65,
    "SYMMETRIC_RELATIVE": 0.48,
}
INTERVAL_TYPES = list(COVERAGE)

# adaptive interval: (predicted below, lower factor, added to the prediction)
ADAPTIVE_STEPS = [(10000, 0.90, 4000), (25000, 0.85, 12000)]
ADAPTIVE_TOP = {"lower": 0.70, "factor": 1.55, "added": 45000, "ceiling": 120000}

# factors, or amounts, below and above the prediction
ASYMMETRIC = (0.85, 1.55)
ADDITIVE = (5000, 20000)
SYMMETRIC = (0.75, 1.25)

# ---------------------------------------------------------------------------


def rounded(value: str, digits: int) -> str:
    """Round half up on the decimal form.

    The value goes through a decimal with nine places first, so the noise in
    the last bit of a double (from another order of summation) cannot move a tie.
    """
    return f"CAST(round(CAST({value} AS DECIMAL(30,9)), {digits}) AS DOUBLE)"


def nonzero(value: str) -> str:
    """NULL for 0: a missing value is often written as 0."""
    return f"nullif({value}, 0)"


def relative_move(base: str, other: str) -> str:
    """(other - base) / base, 0 where the base is not positive."""
    return f"CASE WHEN {base} > 0 THEN ({other} - {base}) / {base} ELSE 0D END"


def relative_distance(base: str, other: str) -> str:
    return f"CASE WHEN {base} > 0 THEN abs({other} - {base}) / {base} ELSE 0D END"


def direction(move: str) -> str:
    return case(
        (f"{move} < 0", "'EARLIER_NUMERICALLY'"),
        (f"{move} > 0", "'LATER_NUMERICALLY'"),
        (f"{move} = 0", "'UNCHANGED'"),
    )


def at_least_one(value: str) -> str:
    return f"greatest(1D, {value})"


def evidence_strength(observations: str, has_preceding: str) -> str:
    return case(
        (f"{has_preceding} OR {observations} >= 3", "'STRONG'"),
        (f"{observations} = 2", "'MODERATE'"),
        (f"{observations} = 1", "'SPARSE'"),
        default="'INSUFFICIENT_EVIDENCE'",
    )


def data_quality(observations: str) -> str:
    return case(
        (f"{observations} = 1", "'INSUFFICIENT'"), (f"{observations} = 2", "'SPARSE'"), default="'OBSERVABLE'"
    )


def interval_bounds(p: str, interval_type: str) -> tuple[str, str]:
    """(lower, upper) before rounding."""
    if interval_type == "VOLATILITY_ADAPTIVE_WIDE":
        top = ADAPTIVE_TOP
        lower = case(
            *[(f"{p} < {limit}", f"{p} * {factor}D") for limit, factor, _ in ADAPTIVE_STEPS],
            default=f"{p} * {top['lower']}D",
        )
        widest = f"least({top['ceiling']}D, greatest({p} * {top['factor']}D, {p} + {top['added']}))"
        upper = case(
            *[(f"{p} < {limit}", f"{p} + {added}") for limit, _, added in ADAPTIVE_STEPS], default=widest
        )
    elif interval_type == "ASYMMETRIC_RELATIVE_EMPIRICAL":
        lower, upper = (f"{p} * {factor}D" for factor in ASYMMETRIC)
    elif interval_type == "ADDITIVE_EMPIRICAL":
        lower, upper = f"{p} - {ADDITIVE[0]}", f"{p} + {ADDITIVE[1]}"
    elif interval_type == "SYMMETRIC_RELATIVE":
        lower, upper = (f"{p} * {factor}D" for factor in SYMMETRIC)
    else:
        raise ValueError(f"unknown interval type {interval_type!r}")
    # greatest() skips NULLs, and a missing prediction must not become the bound 1
    return f"CASE WHEN {p} IS NOT NULL THEN {at_least_one(lower)} END", upper


def interval(lower: str, upper: str, predicted: str, interval_type: str) -> str:
    """Interval as a struct, from bounds that are columns already; NULL without a prediction."""
    relative = f"CASE WHEN {predicted} > 0 THEN ({upper} - {lower}) / {predicted} ELSE 0D END"
    return case(
        (
            f"{predicted} IS NOT NULL",
            struct(
                {
                    "lower_bound": rounded(lower, 1),
                    "upper_bound": rounded(upper, 1),
                    "interval_type": text(interval_type),
                    "target_coverage": f"{COVERAGE[interval_type]}D",
                    "interval_width": rounded(f"({upper} - {lower})", 1),
                    "relative_width": rounded(relative, 4),
                }
            ),
        )
    )


def decision_state(rank: str, lower: str, estimate: str, upper: str) -> str:
    """Where a candidate's rank lies against a predicted interval; a smaller rank is better."""
    return case(
        (f"{lower} IS NULL OR {estimate} IS NULL OR {upper} IS NULL", "'INSUFFICIENT_EVIDENCE'"),
        (f"{rank} < {lower}", "'NUMERICALLY_BELOW_LOWER_BOUND'"),
        (f"{rank} <= {estimate}", "'WITHIN_LOWER_HALF'"),
        (f"{rank} <= {upper}", "'WITHIN_UPPER_HALF'"),
        default="'NUMERICALLY_ABOVE_UPPER_BOUND'",
    )


def containment(rank: str, closing: str) -> dict[str, str]:
    """within, difference and label of a candidate's rank against a closing rank."""
    gap = f"abs({rank} - {closing})"
    within = f"{rank} <= {closing}"
    label = case(
        (within, f"concat('Within by ', {thousands(gap)})"),
        (f"NOT ({within})", f"concat('Beyond by ', {thousands(gap)})"),
    )
    return {"within": within, "difference": gap, "label": label}


def thousands(value: str) -> str:
    """12345.6 -> '12,346' (half-even)."""
    return f"format_number({value}, 0)"


def signed_thousands(value: str) -> str:
    return f"concat(CASE WHEN {value} >= 0 THEN '+' ELSE '' END, {thousands(value)})"


def in_lakhs(value: str) -> str:
    """Amount in units of 100,000 with two digits."""
    return f"format_number({value} / 100000, 2)"


def hours_between(later: str, earlier: str) -> str:
    return (
        f"(unix_micros(CAST({later} AS TIMESTAMP)) - unix_micros(CAST({earlier} AS TIMESTAMP))) / 3600000000D"
    )
