"""Scalar expressions shared by the feature and score operators (EXP-14..29)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from .. import fixed
from .text import number, text


def or_default(expression: str, default: float | int = 0.0) -> str:
    return f"coalesce({expression}, {number(default)})"


def clip(expression: str, low: float | None = None, high: float | None = None) -> str:
    """Bound a number; NULL stays NULL (greatest/least alone would skip it)."""
    bounded = expression
    if high is not None:
        bounded = f"least({bounded}, {number(high)})"
    if low is not None:
        bounded = f"greatest({bounded}, {number(low)})"
    return f"if({expression} is null, null, {bounded})"


def safe_ratio(part: str, whole: str) -> str:
    """Ratio with one added below, never a division by zero."""
    return f"{part} / ({whole} + 1)"


def own_ratio(part: str, whole: str) -> str:
    """Ratio by an own count; 0 when the count is 0."""
    return f"coalesce(try_divide({part}, {whole}), 0D)"


def as_flag(condition: str) -> str:
    """1 or 0; an undefined comparison counts as 0."""
    return f"if({condition}, 1, 0)"


def as_whole(expression: str) -> str:
    """Drop the fraction, toward zero."""
    return f"cast({expression} as int)"


def either(condition: str, yes: str, no: str) -> str:
    return f"if({condition}, {yes}, {no})"


def by_cuts(expression: str, cuts: Sequence[tuple[str, float]], default: str) -> str:
    """Name of the first cut that the value reaches."""
    reached = [f"when {expression} >= {number(cut)} then {text(name)}" for name, cut in cuts]
    return f"case {' '.join(reached)} else {text(default)} end"


def floor_where(condition: str, expression: str, floor: float) -> str:
    """Raise matching rows to at least ``floor``."""
    return f"if({condition}, greatest({expression}, {number(floor)}), {expression})"


def round_half_even(expression: str, digits: int = 2) -> str:
    return f"bround({expression}, {digits})"


def tidy(expression: str) -> str:
    return f"lower(trim({expression}))"


def shorten(expression: str, length: int = 45) -> str:
    return f"substring({expression}, 1, {length})"


def join_texts(
    pairs: Iterable[tuple[str, str]], default: str, separator: str = fixed.TEXT_SEPARATOR
) -> str:
    """Texts whose condition holds, joined; ``default`` if none holds."""
    shown = [f"if({condition}, {text(words)}, null)" for condition, words in pairs]
    joined = f"concat_ws({', '.join([text(separator), *shown])})"
    return f"coalesce(nullif({joined}, ''), {text(default)})"


def weighted_sum(parts: Iterable[tuple[float, str]]) -> str:
    return "(" + " + ".join(f"{number(weight)} * {e}" for weight, e in parts) + ")"


def product_of(expressions: Iterable[str]) -> str:
    return "(" + " * ".join(expressions) + ")"
