"""Predictions against labels (EVL-1..4, AGG-17). One aggregate, no collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY = 1e-9


def _cells(label: str, predicted: str) -> list[Column]:
    yes, hit = F.col(label) == 1, F.col(predicted) == 1
    no, miss = F.col(label) == 0, F.col(predicted) == 0
    return [
        F.count_if(yes & hit).alias("tp"),
        F.count_if(no & hit).alias("fp"),
        F.count_if(yes & miss).alias("fn"),
        F.count_if(no & miss).alias("tn"),
    ]


def labels_per_user(log: DataFrame) -> DataFrame:
    """The label of a user is the highest of its rows."""
    return (
        log.where(F.col("user").isNotNull()).groupBy("user").agg(F.max("label").alias("label"))
    )


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG-17."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def prediction_report(
    df: DataFrame, label: str = "ground_truth_label", predicted: str = "is_anomaly"
) -> DataFrame:
    """EVL-1: counts, and ratios with a tiny constant in each denominator."""
    counts = df.agg(
        F.sum(label).alias("actual"), F.sum(predicted).alias("predicted"),
        *_cells(label, predicted)[:3],
    )
    c = F.col
    precision, recall = c("tp") / (c("predicted") + _TINY), c("tp") / (c("actual") + _TINY)
    return counts.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", 2 * c("precision") * c("recall") / (c("precision") + c("recall") + _TINY)
    )


def classification_metrics(
    df: DataFrame, label: str = "label", predicted: str = "anomaly"
) -> DataFrame:
    """EVL-2 and EVL-4: accuracy, precision, recall, F1 (0 when undefined), AUC.

    The area under the curve of hard predictions is the mean of the true
    positive and true negative rates; NULL if only one class occurs.
    """
    c = F.col

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    positive, negative = c("tp") + c("fn"), c("tn") + c("fp")
    auc = (F.try_divide(c("tp"), positive) + F.try_divide(c("tn"), negative)) / 2
    return df.agg(*_cells(label, predicted)).select(
        ratio(c("tp") + c("tn"), positive + negative).alias("accuracy"),
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), positive).alias("recall"),
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1_score"),
        auc.alias("roc_auc"),
    )


def confusion_matrix(
    df: DataFrame, label: str = "label", predicted: str = "anomaly"
) -> DataFrame:
    """EVL-3: all four cells, also empty ones."""
    cells = df.agg(*_cells(label, predicted))
    spread = F.expr(
        "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (label, predicted, n)"
    )
    return cells.select(spread)
