"""Expressions as SQL text.

Operators generate many expressions from tables of names and weights. As text
they reach Spark in one piece; building the same trees column by column costs
the driver a round trip to the JVM for every node. Arguments are SQL text too:
a quoted column name (``col``) or another expression.
"""

from .events import (
    after_hours,
    contains_word,
    critical_activity,
    event_hour,
    event_weekday,
    external_recipient,
    late_night,
    parse_date,
    sensitive_file,
    unknown_device,
    weekend,
)
from .scalars import (
    as_flag,
    as_whole,
    by_cuts,
    clip,
    either,
    floor_where,
    join_texts,
    or_default,
    own_ratio,
    product_of,
    round_half_even,
    safe_ratio,
    shorten,
    tidy,
    weighted_sum,
)
from .text import aggregate, col, number, text, with_expressions

__all__ = [
    "after_hours",
    "aggregate",
    "as_flag",
    "as_whole",
    "by_cuts",
    "clip",
    "col",
    "contains_word",
    "critical_activity",
    "either",
    "event_hour",
    "event_weekday",
    "external_recipient",
    "floor_where",
    "join_texts",
    "late_night",
    "number",
    "or_default",
    "own_ratio",
    "parse_date",
    "product_of",
    "round_half_even",
    "safe_ratio",
    "sensitive_file",
    "shorten",
    "text",
    "tidy",
    "unknown_device",
    "weekend",
    "weighted_sum",
    "with_expressions",
]
