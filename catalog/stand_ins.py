"""Deterministic stand-ins for model output, so that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden.operators import logs
from driftwarden.operators.forest import prediction_table
from driftwarden.session import materialize
from driftwarden.sources.events import combined_log


def decided_features(spark, folder):
    """The 36 features, forwarded signals, label, and a score in place of a forest's."""
    log = combined_log(spark, folder)
    features = logs.forward_signals(logs.log_features(log), log)
    scores = log.groupBy("user").agg(
        F.expr("0.25D * max(value) - avg(value) as decision"), F.max("label").alias("label")
    )
    return logs.join_left(features, scores)


def predictions(spark, folder):
    decided = materialize(decided_features(spark, folder).select("user", "decision", "label"))
    return prediction_table(
        decided.withColumnRenamed("decision", "iforest_raw_score"), "iforest_raw_score"
    )
