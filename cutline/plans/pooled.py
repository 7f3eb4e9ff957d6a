"""Plans that stay balanced when one group holds a large share of all rows.

* ``pooled_medians``: exact medians of groups of any size.
* ``first_per_key``: mark the first row of each key without a window over the key.
* ``numbered``: row numbers within groups of any size.
* ``lookup``: many-to-one join whose hot keys adaptive execution can split.
* ``broadcast_within``: a broadcast hint for tables that were measured first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.sql import inline, text

# a whole number that never falls as the value grows, about 0.1 % of the value wide
_BUCKET = "floor(signum(_v) * log1p(abs(_v) * 1000) * 1000)"


def pooled_medians(df: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Exact median of each value (name -> SQL text) within each key; NULLs are ignored.

    ``median()`` would hold all values of a group in one task. Here a first
    pass counts values per (key, bucket), with map-side combine, and finds the
    bucket that holds the middle. A second pass keeps that bucket alone and
    counts its distinct values. The windows therefore see buckets, or the
    values of one bucket, never a whole group.
    """
    keys = list(keys)
    metrics = [{"_m": text(n), "_v": f"CAST({v} AS DOUBLE)"} for n, v in values.items()]
    long = (
        df.selectExpr(*keys, inline(metrics)).filter("_v IS NOT NULL").withColumn("_b", F.expr(_BUCKET))
    )
    part = [*keys, "_m"]
    by = ", ".join(part)
    middle = (
        long.groupBy(*part, "_b")
        .agg(F.expr("count(1) AS _c"))
        .selectExpr(
            *part, "_b", "_c",
            f"sum(_c) OVER (PARTITION BY {by} ORDER BY _b ROWS UNBOUNDED PRECEDING) AS _to",
            f"sum(_c) OVER (PARTITION BY {by}) AS _n",
        )
        .filter("_to > (_n - 1) DIV 2 AND _to - _c <= _n DIV 2")
        .selectExpr(
            *[f"{k} AS _k{i}" for i, k in enumerate(part)],
            "_b AS _kb", "_to - _c AS _below", "(_n - 1) DIV 2 AS _low", "_n DIV 2 AS _high",
        )
    )
    on = " AND ".join([f"{k} <=> _k{i}" for i, k in enumerate(part)] + ["_b = _kb"])
    ranked = (
        long.join(middle, F.expr(on))
        .groupBy(*part, "_b", "_below", "_low", "_high", "_v")
        .agg(F.expr("count(1) AS _c"))
        .selectExpr(
            *part, "_low", "_high", "_v", "_c",
            f"_below + sum(_c) OVER (PARTITION BY {by}, _b ORDER BY _v ROWS UNBOUNDED PRECEDING) AS _to",
        )
    )

    def at(name: str, place: str) -> str:
        return f"max(CASE WHEN _m = {text(name)} AND _to - _c <= {place} AND {place} < _to THEN _v END)"

    return ranked.groupBy(*keys).agg(
        *[F.expr(f"({at(n, '_low')} + {at(n, '_high')}) / 2 AS {n}") for n in values]
    )


def with_medians(
    df: DataFrame, keys: Sequence[str], aggregates: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """Ordinary aggregates (SQL text) and exact medians by the same keys, side by side."""
    keys = list(keys)
    left = df.groupBy(*keys).agg(*[F.expr(a) for a in aggregates])
    right = pooled_medians(df, keys, values).selectExpr(
        *[f"{k} AS _g{i}" for i, k in enumerate(keys)], *values
    )
    on = " AND ".join(f"{k} <=> _g{i}" for i, k in enumerate(keys))
    return left.join(right, F.expr(on), "left").drop(*[f"_g{i}" for i in range(len(keys))])


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    row_id: str,
    eligible: str = "true",
    flag: str = "is_first",
    scope: Sequence[str] = (),
    dealt: bool = False,
) -> DataFrame:
    """Add a flag: this row has the smallest ``row_id`` of its key among eligible rows.

    Keys and ``eligible`` are SQL text. ``row_id`` must be unique, or unique
    within the columns of ``scope``, which then separate the keys as well. The
    smallest id per key is a combined aggregate, and the way back is a join on
    the id itself, so a key shared by a third of all rows loads no single task.
    NULLs in keys are equal. ``dealt`` says that no column of ``scope`` is NULL:
    rows that lie dealt by ``scope`` and id then stay where they are.
    """
    grouped = [*scope, *[k for k in keys if k not in scope]]
    firsts = (
        df.filter(eligible)
        .groupBy(*[F.expr(f"{k} AS _k{i}") for i, k in enumerate(grouped)])
        .agg(F.expr(f"min({row_id}) AS _first"))
        .select(*[f"_k{i}" for i in range(len(scope))], "_first")
    )
    on = " AND ".join([f"{row_id} = _first"] + [f"{c} {'=' if dealt else '<=>'} _k{i}" for i, c in enumerate(scope)])
    return (
        df.join(firsts, F.expr(on), "left")
        .withColumn(flag, F.expr("_first IS NOT NULL"))
        .drop("_first", *[f"_k{i}" for i in range(len(scope))])
    )


def numbered(df: DataFrame, group: Sequence[str], order: str, name: str, span: int = 1 << 16) -> DataFrame:
    """Number rows 1, 2, 3 ... within each group by a unique whole-number column.

    The column is cut into spans. Rows are numbered within a span, and each
    span starts from the count of rows in the spans before it, so no task
    holds more than one span of one group. Group columns must not be NULL.
    """
    group = list(group)
    by = ", ".join(group)
    tagged = df.withColumn("_span", F.expr(f"floor({order} / {span})"))
    starts = (
        tagged.groupBy(*group, "_span")
        .agg(F.expr("count(1) AS _size"))
        .selectExpr(
            *[f"{g} AS _g{i}" for i, g in enumerate(group)],
            "_span AS _gs",
            f"coalesce(sum(_size) OVER (PARTITION BY {by} ORDER BY _span "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _start",
        )
    )
    on = " AND ".join([f"{g} = _g{i}" for i, g in enumerate(group)] + ["_span = _gs"])
    inside = f"row_number() OVER (PARTITION BY {by}, _span ORDER BY {order})"
    return (
        tagged.join(starts, F.expr(on))
        .withColumn(name, F.expr(f"CAST({inside} + _start AS BIGINT)"))
        .drop("_span", "_gs", "_start", *[f"_g{i}" for i in range(len(group))])
    )


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows to a table with one row per key.

    Adaptive execution splits a hot key only if both inputs of the join come
    straight from a shuffle. A table that was just aggregated by the same
    keys does not, as its rows already lie where the join wants them. Joining
    on a key derived from the columns gives both sides a shuffle of their own
    (the table's is the small one), and hot keys on the left are split.
    NULL keys find nothing.
    """
    keys = list(keys)
    hashed = f"xxhash64({', '.join(keys)})"
    right = table.selectExpr(
        f"{hashed} AS _rh",
        *[f"{k} AS _r{i}" for i, k in enumerate(keys)],
        *[c for c in table.columns if c not in keys],
    )
    on = " AND ".join(["_lh = _rh"] + [f"{k} = _r{i}" for i, k in enumerate(keys)])
    return (
        rows.withColumn("_lh", F.expr(hashed))
        .join(right, F.expr(on), how)
        .drop("_lh", "_rh", *[f"_r{i}" for i in range(len(keys))])
    )


def broadcast_within(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """Broadcast a written table of at most ``limit`` bytes as rows; else return it as it is, for a shuffle join.

    A row is taken at its widths of fixed types plus the longest texts of the table, so the bound holds for any table.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    longest = " + ".join([f"coalesce(max(octet_length(`{c}`)), 0)" for c in wide] or ["0"])
    rows, text = df.agg(F.count(F.lit(1)), F.expr(longest)).first()
    return F.broadcast(df) if rows * (16 * len(df.columns) + text) <= limit else df
