"""Statistics over a short, fixed list of expressions (one per year), NULLs skipped.

Arguments and results are SQL text. The list is as long as the calendar, so
these are plain row expressions that stay in generated code. Statistics across
many rows are in ``plans.pooled``.
"""

from __future__ import annotations

from collections.abc import Sequence

Exprs = Sequence[str]


def count_of(xs: Exprs) -> str:
    return "(" + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in xs) + ")"


def total_of(xs: Exprs) -> str:
    return "(" + " + ".join(f"coalesce(CAST({x} AS DOUBLE), 0D)" for x in xs) + ")"


def min_of(xs: Exprs) -> str:
    return f"least({', '.join(xs)})" if len(xs) > 1 else xs[0]


def max_of(xs: Exprs) -> str:
    return f"greatest({', '.join(xs)})" if len(xs) > 1 else xs[0]


def mean_of(xs: Exprs, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {total_of(xs)} / {n} END"


def median_of(xs: Exprs, n: str) -> str:
    """Middle value, or the mean of the middle two. NULLs sort first and are stepped over."""
    ordered = f"sort_array(array({', '.join(f'CAST({x} AS DOUBLE)' for x in xs)}))"
    low = f"get({ordered}, CAST({len(xs)} - {n} + ({n} - 1) DIV 2 AS INT))"
    high = f"get({ordered}, CAST({len(xs)} - {n} + {n} DIV 2 AS INT))"
    return f"CASE WHEN {n} > 0 THEN ({low} + {high}) / 2 END"


def sample_sd_of(xs: Exprs, n: str, mean: str) -> str:
    """Sample standard deviation; NULL for fewer than two values."""
    squares = total_of([f"({x} - {mean}) * ({x} - {mean})" for x in xs])
    return f"CASE WHEN {n} > 1 THEN sqrt({squares} / ({n} - 1)) END"


def mad_of(xs: Exprs, n: str, median: str) -> str:
    """Median of the distances from the median; NULL for fewer than two values."""
    return f"CASE WHEN {n} > 1 THEN {median_of([f'abs({x} - {median})' for x in xs], n)} END"


def cv_of(mean: str, sd: str) -> str:
    """Coefficient of variation: deviation over mean; NULL for mean 0."""
    return f"CASE WHEN {mean} <> 0 THEN {sd} / {mean} END"


def latest_of(xs: Exprs) -> str:
    """Last value that is not NULL; the list is in time order."""
    return f"coalesce({', '.join(reversed(list(xs)))})"


def values_array(xs: Exprs) -> str:
    return f"array_compact(array({', '.join(xs)}))"
