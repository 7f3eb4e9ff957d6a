"""Small helpers to write expressions as SQL text.

Expressions that are generated from the calendar have hundreds of nodes. As
text each costs one call into the JVM; as Column operators each node costs one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values: Sequence[str]) -> str:
    """A parenthesised list of string literals, for IN."""
    return "(" + ", ".join(text(v) for v in values) + ")"


def case(*branches: tuple[str, str], default: str = "NULL") -> str:
    """CASE WHEN test THEN value ... ELSE default END."""
    if not branches:
        return default
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in branches) + f" ELSE {default} END"


def struct(fields: Mapping[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields.items()) + ")"


def inline(rows: Sequence[Mapping[str, str]]) -> str:
    """Turn one row into several: ``select`` this and get the fields as columns."""
    return "inline(array(" + ", ".join(struct(r) for r in rows) + "))"


def expr(sql: str, name: str | None = None) -> Column:
    column = F.expr(sql)
    return column.alias(name) if name else column


def columns(named: Mapping[str, str]) -> dict[str, Column]:
    """For ``withColumns``."""
    return {n: F.expr(v) for n, v in named.items()}


def once(df: DataFrame, named: Mapping[str, str | Column]) -> DataFrame:
    """Add columns that are worked out once per row, whatever refers to them.

    The optimizer copies a plain column's expression into every filter and column that refers to it, which multiplies
    the work of chained text rules. The values of a generator it leaves alone.
    """
    values = F.struct(*[(F.expr(v) if isinstance(v, str) else v).alias(n) for n, v in named.items()])
    return df.select("*", F.inline_outer(F.array(values)))
