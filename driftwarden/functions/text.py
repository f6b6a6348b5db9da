"""SQL text for names and literals, and its use on a DataFrame."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame


def col(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(value: float | int | None) -> str:
    """A literal: whole numbers as they are, fractions as exact doubles; NaN and the
    infinities by name."""
    if value is None:
        return "cast(null as double)"
    if isinstance(value, int):
        return str(value)
    if not math.isfinite(value):
        return f"double('{float(value)!r}')"
    return f"{float(value)!r}D"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_expressions(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """Add columns in one projection; one of the same name is replaced in place."""
    if not expressions:
        return df
    present = df.columns
    old = [
        f"{expressions[c]} as {col(c)}" if c in expressions else col(c) for c in present
    ]
    new = [f"{e} as {col(c)}" for c, e in expressions.items() if c not in set(present)]
    return df.selectExpr(*old, *new)


def aggregate(df: DataFrame, expressions: Mapping[str, str]) -> DataFrame:
    """One row of named aggregates over the whole table."""
    return df.selectExpr(*[f"{e} as {col(c)}" for c, e in expressions.items()])
