"""Totals per key together with exact distinct counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals_per_key(
    rows: DataFrame, key: str, totals: Mapping[str, str], distinct: Mapping[str, str]
) -> DataFrame:
    """``groupBy(key)`` with aggregate texts and with numbers of distinct values.

    ``count(distinct)`` beside other aggregates would send every total along
    with every (key, value) pair, and with two of them copy each row per count.
    Here the totals are combined per key before they are shuffled. One more scan serves
    all distinct counts: each row gives a tagged value for each of them, and bare (key,
    tag, value) rows are shuffled, which also spreads a hot key. Both results are
    partitioned by the key, so joining them shuffles nothing more.
    """
    result = rows.groupBy(key).agg(*[F.expr(f"{e} as {name}") for name, e in totals.items()])
    if not distinct:
        return result
    tagged = ", ".join(
        f"named_struct('tag', {i}, 'value', cast({e} as string))" for i, e in enumerate(distinct.values())
    )
    pairs = (
        rows.selectExpr(f"`{key}`", f"inline(array({tagged}))").where("value is not null").distinct()
    )
    counted = pairs.groupBy(key).agg(
        *[F.expr(f"count_if(tag = {i}) as {name}") for i, name in enumerate(distinct)]
    )
    return result.join(counted, key, "left").fillna(0, subset=list(distinct))
