"""History as of a time, over an open set of times.

``wide_panel`` has a column per slot of a calendar, which suits known years. Here the times are whatever the facts hold:
targets and facts are put together, sorted by key and time, and a running state of the facts so far is read off at each
target. A key's times are cut into spans, each of which starts from the state at the end of those before it, so that a
key with most of the facts is spread over many tasks. Facts go through two exchanges, one that leaves a fact per time and
one that sorts the spans; what is left, a row per target and per span, is written down, as it is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.sources.workdir import kept

HISTORY = ["depth", "total", "lowest", "highest", "latest", "latest_at", "second", "second_at"]


def as_of(
    targets: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, when: str, value: str, span: int = 4096
) -> DataFrame:
    """Each target row with a summary of the facts of its key that lie strictly before it.

    ``at`` (over targets) and ``when`` (over facts) are SQL text of whole numbers, such as a year or a day; ``value`` is
    SQL text over facts. Of several facts of a key at one time the greatest value counts; NULL values, times and keys
    count nowhere. Adds ``depth`` (number of times), ``total``, ``lowest`` and ``highest`` of the values, ``latest`` with
    ``latest_at``, and ``second`` with ``second_at``, the one before. Without a history depth is 0, the others NULL; so
    it is for targets with a NULL key or time. ``span`` is the width of a span in units of time.
    """
    keys = list(keys)
    by = ", ".join(keys)
    held = (
        facts.selectExpr(*keys, f"CAST({when} AS BIGINT) AS _t", f"{value} AS _v")
        .where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, "_t", "_v"]))
        .groupBy(*keys, "_t").agg(F.max("_v").alias("_v"))
    )
    asked = targets.withColumn("_t", F.expr(f"CAST({at} AS BIGINT)")).select(
        *keys, "_t", F.struct(*targets.columns).alias("_row")
    )
    # targets come before facts of their own time
    order = f"OVER (PARTITION BY {by}, _span ORDER BY _t, _row IS NULL"
    inside, before = f"{order} ROWS UNBOUNDED PRECEDING)", f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = (
        held.unionByName(asked, allowMissingColumns=True)
        .withColumn("_span", F.expr(f"floor(_t / {span})"))
        .withColumn("_prev", F.expr(f"last(CASE WHEN _row IS NULL THEN struct(_t, _v) END, true) {before}"))
    )
    # the state within a span, at each target and at the end; facts are in no exchange after this one
    states = kept(
        rows.selectExpr(
            *keys, "_span", "_row", f"lead(1) {order}) IS NULL AS _end", f"count(_row) {inside} AS _n", f"count(_v) {inside} AS _c",
            f"sum(_v) {inside} AS _s", f"min(_v) {inside} AS _lo", f"max(_v) {inside} AS _hi",
            f"last(CASE WHEN _row IS NULL THEN struct(_t, _v, _prev) END, true) {inside} AS _in",
        ).where("_row IS NOT NULL OR _end"),
        "states",
    )
    earlier = f"OVER (PARTITION BY {by} ORDER BY _span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = (
        states.where(" AND ".join(["_end", *[f"{c} IS NOT NULL" for c in [*keys, "_span"]]]))
        # the only fact of a span follows the last one of the spans before
        .withColumn("_before", F.expr(f"last(CASE WHEN _c > 0 THEN struct(_in._t, _in._v) END, true) {earlier}"))
        .withColumn("_last", F.expr("CASE WHEN _c > 0 THEN struct(_in._t, _in._v, coalesce(_in._prev, _before) AS _prev) END"))
        .selectExpr(
            *[f"{k} AS _k{i}" for i, k in enumerate(keys)], "_span AS _at", "_n AS _asked",
            f"sum(_c) {earlier} AS _c0", f"sum(_s) {earlier} AS _s0", f"min(_lo) {earlier} AS _lo0", f"max(_hi) {earlier} AS _hi0",
            f"last(_last, true) {earlier} AS _last0",
        )
        .where("_asked > 0 AND _c0 > 0")
    )
    on = " AND ".join([f"{k} = _k{i}" for i, k in enumerate(keys)] + ["_span = _at"])
    latest = "struct(_in._t, _in._v, coalesce(_in._prev, struct(_last0._t, _last0._v)) AS _prev)"
    return states.where("_row IS NOT NULL").join(starts, F.expr(on), "left").selectExpr(
        "_row", "_c + coalesce(_c0, 0L) AS depth", "_s", "_s0", "least(_lo, _lo0) AS lowest", "greatest(_hi, _hi0) AS highest",
        f"CASE WHEN _in IS NULL THEN _last0 ELSE {latest} END AS _l",
    ).selectExpr(
        "_row.*", "depth", "CASE WHEN depth > 0 THEN coalesce(_s, 0) + coalesce(_s0, 0) END AS total", "lowest", "highest",
        "_l._v AS latest", "_l._t AS latest_at", "_l._prev._v AS second", "_l._prev._t AS second_at",
    )
