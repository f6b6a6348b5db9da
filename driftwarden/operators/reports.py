"""Result tables: distributions, top lists, summaries (AGG-13..18, SRT, TOP, RPT, FLT)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import shorten
from .statistics import quantiles

RESULT_COLUMNS = ("user", "anomaly_score", "risk_score", "risk_level", "reason")


def with_level(df: DataFrame, level: str, column: str = "risk_level") -> DataFrame:
    """FLT-1."""
    return df.where(F.col(column) == level)


def over_cut(df: DataFrame, cut: float = 70.0, column: str = "risk_score") -> DataFrame:
    """FLT-2."""
    return df.where(F.col(column) > cut)


def _ranking(score: str) -> list[Column]:
    """Highest score first; ties by user, so that every list is reproducible."""
    return [F.col(score).desc_nulls_last(), F.col("user").asc()]


def ranked(
    df: DataFrame, columns: Sequence[str] = RESULT_COLUMNS, score: str = "risk_score"
) -> DataFrame:
    """SRT-1."""
    return df.select(*columns).orderBy(*_ranking(score))


def top(df: DataFrame, k: int = 10, score: str = "risk_score") -> DataFrame:
    """TOP-1, TOP-2: each task keeps its best ``k``; no full sort."""
    return df.orderBy(*_ranking(score)).limit(k)


def top_high_users(
    df: DataFrame, k: int = 20, score: str = "final_risk_score", level: str = "risk_tier"
) -> DataFrame:
    """TOP-3, with the indicators cut for display."""
    return top(with_level(df, "High", level), k, score).selectExpr(
        "`user`", score, level, f"{shorten('risk_indicators')} as key_indicators"
    )


def high_risk_details(df: DataFrame) -> DataFrame:
    """TOP-4."""
    return ranked(with_level(df, "High"))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """TOP-5."""
    return df.limit(rows)


def level_distribution(df: DataFrame, column: str = "risk_level") -> DataFrame:
    """AGG-13: High, Medium and Low with count and percentage, also when empty."""
    counts = [F.count_if(F.col(column) == level).alias(level) for level in fixed.LEVELS]
    row = df.agg(F.count("*").alias("total"), *counts)
    share = F.coalesce(F.try_divide(100 * F.col("n"), F.col("total")), F.lit(0.0))
    return row.unpivot(["total"], list(fixed.LEVELS), column, "n").select(
        column, "n", share.alias("pct")
    )


def highest(df: DataFrame, columns: Sequence[str], score: str = "risk_score") -> Column:
    """AGG-14: the row with the highest score, as a struct to aggregate."""
    order = F.struct((-F.col(score)).alias("rank"), F.col("user"))
    return F.min_by(F.struct(*columns), order)


def highest_row(df: DataFrame, columns: Sequence[str], score: str = "risk_score") -> DataFrame:
    return df.agg(highest(df, columns, score).alias("r")).select("r.*")


def score_distribution(
    df: DataFrame, score: str, at: Sequence[float] = (0.75, 0.90, 0.95)
) -> DataFrame:
    """AGG-15: min, max, mean, std and upper quantiles in one row."""
    cuts = quantiles(df, {score: at})[score]
    c = F.col(score)
    return df.agg(
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        *[F.lit(cuts[p]).cast("double").alias(f"p{round(p * 100)}") for p in at],
    )


def histogram(
    df: DataFrame, score: str = "anomaly_score", bins: int = 20, low: float = 0.0, high: float = 100.0
) -> DataFrame:
    """AGG-16: equal bins, the last one closed; empty bins are listed with 0.

    Scores beyond either end count in the bin at that end. Missing scores (NULL or NaN)
    have a row of their own, with NULL as bin, if there are any.
    """
    c = F.nullif(F.col(score).cast("double"), F.lit(float("nan")))
    bucket = F.width_bucket(c, F.lit(low), F.lit(high), F.lit(bins))
    number = F.when(c.isNotNull(), F.greatest(F.least(bucket, F.lit(bins)), F.lit(1)))
    counts = df.groupBy(number.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    width = (high - low) / bins
    return every.join(counts, "bin", "left").union(counts.where("bin is null")).select(
        "bin",
        (F.lit(low) + (F.col("bin") - 1) * width).alias("bin_from"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def prediction_counts(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    """AGG-18."""
    total, anomalous = F.count("*"), F.count_if(F.col(flag) == 1)

    def share(part: Column) -> Column:
        return F.coalesce(F.try_divide(100 * part, total), F.lit(0.0))

    return df.agg(
        total.alias("total"),
        (total - anomalous).alias("normal"),
        anomalous.alias("anomalous"),
        share(total - anomalous).alias("normal_pct"),
        share(anomalous).alias("anomalous_pct"),
    )


def risk_report(df: DataFrame) -> DataFrame:
    """RPT-1: users, thresholds and distribution, one row per tier.

    The top list of the report is ``top_high_users``.
    """
    tier, total = F.col("risk_tier"), F.count("*")
    row = df.agg(
        total.alias("total_users"),
        F.max("medium_threshold").alias("medium_threshold"),
        F.max("high_threshold").alias("high_threshold"),
        *[F.count_if(tier == level).alias(level) for level in fixed.LEVELS],
    )
    keys = ["total_users", "medium_threshold", "high_threshold"]
    share = F.coalesce(F.try_divide(100 * F.col("n"), F.col("total_users")), F.lit(0.0))
    return row.unpivot(keys, list(fixed.LEVELS), "risk_tier", "n").withColumn("pct", share)


def executive_summary(df: DataFrame) -> DataFrame:
    """RPT-2: totals per level and the highest user, in one aggregate."""
    level = F.col("risk_level")
    return df.agg(
        F.count("*").alias("total_users"),
        *[F.count_if(level == name).alias(f"{name.lower()}_risk") for name in fixed.LEVELS],
        highest(df, ["user", "risk_score", "risk_level", "reason"]).alias("r"),
    ).select(
        "total_users",
        *[f"{name.lower()}_risk" for name in fixed.LEVELS],
        F.col("r.user").alias("highest_user"),
        F.col("r.risk_score").alias("highest_score"),
        F.col("r.risk_level").alias("highest_level"),
        F.col("r.reason").alias("highest_reason"),
    )
