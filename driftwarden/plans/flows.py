"""The three flows: log risk, profile risk, and training.

Each per-user table is computed once and stored, so the logs behind it are
scanned once however many statistics passes follow.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame

from .. import fixed
from ..functions import either, with_expressions
from ..operators import evaluation
from ..operators import logs as log_ops
from ..operators import schema
from ..operators.forest import AnomalyModel, prediction, rounded_suspicion, suspicion
from ..operators.profiles import profile_features, training_layout
from ..operators.scoring import apply_rules, score_profiles
from ..operators.statistics import impute_medians
from ..session import materialize


def train_log_model(profile: DataFrame, **settings: object) -> AnomalyModel:
    """Fit the log flow's model on the training layout of user profiles."""
    training = materialize(training_layout(materialize(profile)).fillna(0))
    return AnomalyModel.fit(
        training, fixed.LOG_FEATURES, **{"trees": fixed.LOG_TREES, **settings}
    )


def train_profile_model(features: DataFrame, **settings: object) -> AnomalyModel:
    """Fit the profile flow's model on all numeric features, gaps set to medians."""
    columns = schema.numeric_features(features)
    return AnomalyModel.fit(impute_medians(features, columns), columns, **settings)


def analyze_threats(
    features: DataFrame, model: AnomalyModel | None = None, decision: str | None = None
) -> DataFrame:
    """SCR-13: anomaly flag and score, rule score with floors, level and reason.

    The decision score comes from the model, or from an existing column. Features without
    a user get ids by their contents.
    """
    df = schema.add_missing(schema.ensure_user(features)).fillna(0, subset=list(fixed.LOG_FEATURES))
    name = decision or "_decision"
    if model is not None:
        df = model.decide(df, name)
    df = materialize(df)
    df = with_expressions(rounded_suspicion(df, name), {"anomaly": _is_anomaly(name)})
    return apply_rules(df).drop("_decision")


def _is_anomaly(decision: str) -> str:
    return either(f"{prediction(decision)} = -1", "1", "0")


def assess_log(
    log: DataFrame | Mapping[str, DataFrame],
    model: AnomalyModel,
    settings: log_ops.LogSettings = log_ops.DEFAULTS,
) -> DataFrame:
    """Raw log, or one log per kind, to threat table: features, forwarded signals,
    model and rules. Equal events give equal threats, in one log or in several."""
    features = log_ops.log_features(log, settings)
    logs = [log] if isinstance(log, DataFrame) else list(log.values())
    events = log_ops.signal_events(logs, settings)
    if events is not None:
        features = log_ops.forward_signals(features, events, settings)
    return analyze_threats(features, model)


def evaluate_threats(
    log: DataFrame | Mapping[str, DataFrame], threats: DataFrame
) -> dict[str, DataFrame] | None:
    """EVL-2..4 and AGG-17 for the flags of ``assess_log`` on the same labelled log: a user
    is positive if one of the log's rows is. None if no log has labels."""
    named = map(schema.canonical_names, [log] if isinstance(log, DataFrame) else log.values())
    labelled = [l.select("user", "label") for l in named if "label" in l.columns]
    if not labelled:
        return None
    labels = evaluation.labels_per_user(reduce(DataFrame.unionByName, labelled))
    flags = threats.select("user", "anomaly")
    joined = materialize(log_ops.join_left(flags, labels).where("label is not null"))
    return {
        "labels": evaluation.label_distribution(joined),
        "metrics": evaluation.classification_metrics(joined),
        "confusion": evaluation.confusion_matrix(joined),
    }


def assess_profiles(
    profile: DataFrame, model: AnomalyModel | None = None, blended: str = "iforest_raw_score"
) -> DataFrame:
    """User profiles to risk tiers with indicators; blends the model if given. Profiles
    without a user get ids by their contents."""
    profile = materialize(schema.ensure_user(profile))
    return assess_features(materialize(profile_features(profile)), model, blended)


def assess_features(
    features: DataFrame, model: AnomalyModel | None = None, blended: str = "iforest_raw_score"
) -> DataFrame:
    """The same from ready profile features. ``blended`` names the model's score that the
    blend takes as lower for more anomalous users; ``iforest_anomaly_score`` is higher
    for them, so that it lowers their risk."""
    if model is None:
        return score_profiles(features)
    return score_profiles(materialize(add_predictions(features, model)), anomaly=blended)


def add_predictions(features: DataFrame, model: AnomalyModel) -> DataFrame:
    """MDL-2..6 as columns in place (JON-5)."""
    columns = model.scaler.columns
    filled = impute_medians(schema.add_missing(features, columns, 0.0), columns)
    raw = "iforest_raw_score"
    decided = materialize(model.decide(filled, raw))
    return with_expressions(
        suspicion(decided, raw, "iforest_anomaly_score"),
        {"iforest_prediction": prediction(raw), "is_anomaly": _is_anomaly(raw)},
    )
