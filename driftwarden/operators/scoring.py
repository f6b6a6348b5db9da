"""Risk scores, levels and explanations (SCR-1..13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from .. import fixed
from ..functions import (
    by_cuts,
    clip,
    col,
    either,
    floor_where,
    join_texts,
    number,
    text,
    weighted_sum,
    with_expressions,
)
from ..session import materialize
from .schema import column_or_zero
from .statistics import quantiles, summarize, unit_range

Indicator = tuple[str, float, str, str]

# --- profile flow: weighted tiers ---------------------------------------------


def _tiers(indicators: Sequence[Indicator]) -> dict[str, list[Indicator]]:
    grouped: dict[str, list[Indicator]] = {}
    for indicator in indicators:
        grouped.setdefault(indicator[2], []).append(indicator)
    return grouped


def tier_scores(
    df: DataFrame, indicators: Sequence[Indicator] = fixed.INDICATORS
) -> DataFrame:
    """SCR-1: ``score_tier_*`` in [0, 1] per tier; one statistics pass for all.

    Indicators are clipped at 0 before the min-max. Clipping keeps the order, so
    the clipped bounds are the bounds clipped, with no further pass.
    """
    present = df.columns
    values = {name: column_or_zero(present, name) for name, *_ in indicators}
    bounds = summarize(
        df.selectExpr(*[f"{e} as {col(c)}" for c, e in values.items()]), values, ("lo", "hi")
    )

    def normed(name: str) -> str:
        low, high = bounds[name]["lo"], bounds[name]["hi"]
        if low is None:
            return "0D"
        return unit_range(clip(values[name], low=0.0), max(low, 0.0), max(high, 0.0))

    scores = {}
    for tier, members in _tiers(indicators).items():
        total = sum(weight for _, weight, _, _ in members)
        parts = [(weight / total, normed(name)) for name, weight, _, _ in members]
        scores[f"score_tier_{tier.lower()}"] = clip(weighted_sum(parts), 0.0, 1.0)
    return with_expressions(df, scores)


def base_risk(
    df: DataFrame, multipliers: Mapping[str, float] = fixed.TIER_MULTIPLIERS
) -> DataFrame:
    """SCR-2: ``base_risk_score``, the weighted tiers min-maxed to 0..100."""
    total = weighted_sum([(m, f"score_tier_{t.lower()}") for t, m in multipliers.items()])
    stats = summarize(df.selectExpr(f"{total} as total"), ["total"], ("lo", "hi"))["total"]
    score = f"{unit_range(total, stats['lo'], stats['hi'])} * 100"
    return with_expressions(df, {"base_risk_score": score})


def blend_anomaly(
    df: DataFrame, anomaly: str | None = None, shares: tuple[float, float] = fixed.BLEND
) -> DataFrame:
    """SCR-3: blend with the model score, or leave it NULL when there is none.

    The anomaly column is lower for more anomalous users.
    """
    if anomaly is None or anomaly not in df.columns:
        return with_expressions(
            df, {"anomaly_model_score": number(None), "final_risk_score": "base_risk_score"}
        )
    flipped = f"-{column_or_zero(df.columns, anomaly)}"
    stats = summarize(df.selectExpr(f"{flipped} as flipped"), ["flipped"], ("lo", "hi"))["flipped"]
    model = f"{unit_range(flipped, stats['lo'], stats['hi'])} * 100"
    both = weighted_sum(zip(shares, ("base_risk_score", "anomaly_model_score")))
    df = with_expressions(df, {"anomaly_model_score": model})
    return with_expressions(df, {"final_risk_score": clip(both, 0.0, 100.0)})


def bucket(
    df: DataFrame,
    score: str = "final_risk_score",
    at: tuple[float, float] = fixed.BUCKET_QUANTILES,
) -> DataFrame:
    """SCR-4: High from the upper quantile, Medium from the lower, with both cuts."""
    found = quantiles(df, {score: at})[score]
    medium, high = (found[p] or 0.0 for p in at)
    return with_expressions(
        df,
        {
            "risk_tier": by_cuts(col(score), (("High", high), ("Medium", medium)), "Low"),
            "medium_threshold": number(float(medium)),
            "high_threshold": number(float(high)),
        },
    )


def explain_indicators(
    df: DataFrame,
    indicators: Sequence[Indicator] = fixed.INDICATORS,
    tiers: Sequence[str] = fixed.EXPLAINED_TIERS,
    quantile: float = fixed.INDICATOR_QUANTILE,
) -> DataFrame:
    """SCR-5: texts of positive indicators in the top quarter of their column."""
    present = df.columns
    shown = [i for i in indicators if i[2] in tiers and i[0] in present]
    cuts = quantiles(df, {name: [quantile] for name, *_ in shown})
    pairs = [
        (f"{col(n)} > 0 and {col(n)} >= {number(cuts[n][quantile])}", f"[{tier}] {words}")
        for n, _, tier, words in shown
    ]
    return with_expressions(df, {"risk_indicators": join_texts(pairs, fixed.NO_INDICATOR)})


def score_profiles(df: DataFrame, anomaly: str | None = None) -> DataFrame:
    """SCR-1..5 on a table of profile features (JON-6: scores are columns in place).

    The score is stored before it is bucketed: the quantile pass and every
    later filter then read a number instead of the whole tier expression.
    """
    scored = materialize(blend_anomaly(base_risk(tier_scores(df)), anomaly))
    return explain_indicators(bucket(scored))


# --- log flow: rules ----------------------------------------------------------


def rule_score(
    columns: Sequence[str], weights: Mapping[str, float] = fixed.RULE_WEIGHTS
) -> str:
    """SCR-6: weighted ratios; an absent or NULL ratio counts as 0."""
    return weighted_sum([(w, column_or_zero(columns, c)) for c, w in weights.items()])


def activity_boost(
    columns: Sequence[str],
    critical: Sequence[str] = fixed.CRITICAL_ACTIVITIES,
    notable: Sequence[str] = fixed.NOTABLE_ACTIVITIES,
) -> str:
    """SCR-7."""
    if "activity" not in columns:
        return "0D"

    def one_of(words: Sequence[str]) -> str:
        return f"lower(activity) in ({', '.join(map(text, words))})"

    low = either(one_of(notable), number(fixed.NOTABLE_BOOST), "0D")
    return either(one_of(critical), number(fixed.CRITICAL_BOOST), low)


def anomaly_floor(score: str, anomaly: str, floor: float = fixed.ANOMALY_FLOOR) -> str:
    """SCR-8."""
    return floor_where(f"{anomaly} = 1", score, floor)


def multiplier_floor(
    score: str,
    multiplier: str,
    cut: float = fixed.MULTIPLIER_CUT,
    floor: float = fixed.MULTIPLIER_FLOOR,
) -> str:
    """SCR-9."""
    return floor_where(f"{multiplier} >= {number(cut)}", score, floor)


def risk_level(score: str, cuts: Sequence[tuple[str, float]] = fixed.LEVEL_CUTS) -> str:
    """SCR-10, on a score clipped to 0..100; an undefined score is Low."""
    return by_cuts(f"coalesce({score}, 0D)", cuts, "Low")


def reasons(
    columns: Sequence[str], rules: Sequence[tuple[str, float, str]] = fixed.REASONS
) -> str:
    """SCR-11."""
    pairs = [(f"{column_or_zero(columns, c)} > {number(cut)}", words) for c, cut, words in rules]
    return join_texts(pairs, fixed.NO_REASON)


def apply_rules(df: DataFrame) -> DataFrame:
    """SCR-6..11 on user features that may carry ``anomaly``, ``activity`` and
    ``risk_multiplier``: adds ``risk_score``, ``risk_level`` and ``reason``."""
    present = df.columns
    df = with_expressions(df, {"risk_score": f"{rule_score(present)} + {activity_boost(present)}"})
    score = "risk_score"
    if "anomaly" in present:
        score = anomaly_floor(score, "anomaly")
    if "risk_multiplier" in present:
        score = multiplier_floor(score, "risk_multiplier")
    df = with_expressions(df, {"risk_score": clip(score, 0.0, 100.0)})
    return with_expressions(
        df, {"risk_level": risk_level("risk_score"), "reason": reasons(present)}
    )
