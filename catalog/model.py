"""MDL-1..7, SNK-6, SRC-4 and EVL-1..4: the anomaly model and its evaluation."""

from __future__ import annotations

from driftwarden import fixed
from driftwarden.functions import with_expressions
from driftwarden.operators import evaluation, forest, logs, profiles, statistics
from driftwarden.plans import flows
from driftwarden.session import materialize, scratch_path
from driftwarden.sources.events import combined_log, user_profiles
from driftwarden.sources.versions import published

from . import forest_sql as fs
from . import sql as s
from .inputs import PREDICTION_PARTS, PREDICTION_SELECT, TRAINING
from .registry import query, rounded
from .stand_ins import decided_features, predictions


def _log_features(spark, folder):
    return materialize(logs.log_features(combined_log(spark, folder)))


def _model(features):
    return forest.AnomalyModel.fit(features, fixed.LOG_FEATURES, trees=fixed.PROFILE_TREES)


# --- the fitted forest ---------------------------------------------------------------

_TREES = fixed.PROFILE_TREES
_OWN_MODEL = (*s.LOG_PARTS, *fs.model("features", s.ALL36, _TREES))
_OWN_DECISIONS = (
    *_OWN_MODEL,
    'decisions AS (SELECT "user", score - bound AS decision FROM model_scores, cutoff)',
)
_SCORES = fs.recursive(
    s.sql(_OWN_DECISIONS, f'SELECT "user", {s.r("decision", "iforest_raw_score")} FROM decisions')
)
_NODES = (
    "SELECT CAST(tree_id AS INTEGER) AS tree_id, CAST(node_id AS INTEGER) AS node_id,"
    f" CAST(feature AS INTEGER) AS feature, {s.r('threshold')},"
    " CAST(CASE WHEN feature < 0 THEN -1 ELSE 2 * node_id END AS INTEGER) AS left_id,"
    " CAST(CASE WHEN feature < 0 THEN -1 ELSE 2 * node_id + 1 END AS INTEGER) AS right_id,"
    " CAST(size AS INTEGER) AS size, CAST(depth AS INTEGER) AS depth FROM nodes"
)


@query(
    "mdl_1_fit_forest",
    sql=fs.recursive(
        s.sql(
            (*s.LOG_PARTS, fs.long("plain", "features", s.ALL36), *fs.grown("plain", _TREES)), _NODES
        )
    ),
)
def fit_forest(spark, folder):
    features = _log_features(spark, folder)
    return rounded(forest.node_table(features, fixed.LOG_FEATURES, features.count()))


@query("mdl_2_decision_score", sql=_SCORES)
def decision_score(spark, folder):
    features = _log_features(spark, folder)
    return rounded(_model(features).decide(features).select("user", "iforest_raw_score"))


@query("mdl_2_decision_by_joins", sql=_SCORES)
def decision_by_joins(spark, folder):
    features = _log_features(spark, folder)
    model = _model(features)
    scores = forest.score_by_joins(model.scaler.transform(features), model.forest)
    return rounded(scores.selectExpr("`user`", f"score - {model.forest.offset!r}D as iforest_raw_score"))


@query(
    "mdl_3_prediction",
    sql=fs.recursive(
        s.sql(
            _OWN_DECISIONS,
            'SELECT "user", CASE WHEN decision < 0 THEN -1 ELSE 1 END AS iforest_prediction FROM decisions',
        )
    ),
)
def model_prediction(spark, folder):
    features = _log_features(spark, folder)
    decided = _model(features).decide(features)
    return with_expressions(
        decided.select("user", "iforest_raw_score"),
        {"iforest_prediction": forest.prediction("iforest_raw_score")},
    ).drop("iforest_raw_score")


@query("src_4_load_model", sql=_SCORES)
def load_model(spark, folder):
    features = _log_features(spark, folder)
    path = scratch_path(spark, "model")
    _model(features).save(spark, path)
    loaded = forest.AnomalyModel.load(spark, path)
    return rounded(loaded.decide(features).select("user", "iforest_raw_score"))


def _stored(spark, folder, table):
    """A table of a model that was published twice: the newest version counts."""
    features = _log_features(spark, folder)
    path = scratch_path(spark, "model")
    forest.AnomalyModel.fit(features, fixed.LOG_FEATURES[:2], trees=1).save(spark, path)
    _model(features).save(spark, path)
    return published(spark, path)[table]


@query("snk_6_model_nodes", sql=fs.recursive(s.sql(_OWN_MODEL, _NODES)))
def model_nodes(spark, folder):
    return rounded(_stored(spark, folder, "nodes"))


@query(
    "snk_6_model_settings",
    sql=fs.recursive(
        s.sql(
            _OWN_MODEL,
            f"""SELECT CAST(least({fs.SAMPLE}, (SELECT count(*) FROM features)) AS INTEGER) AS sample,
            {s.r('bound', '"offset"')}, '{" ".join(s.ALL36)}' AS columns FROM cutoff""",
        )
    ),
)
def model_settings(spark, folder):
    settings = _stored(spark, folder, "settings")
    return rounded(settings.selectExpr("sample", "offset", "concat_ws(' ', columns) as columns"))


_LOG_TREES = fixed.LOG_TREES
_LOG_MODEL = (
    *s.LOG_PARTS, s.SIGNALS, s.PROFILE, TRAINING,
    *fs.model("trained", s.ALL36, _LOG_TREES),
    *fs.decided("decisions", "features", s.ALL36, "trained", _LOG_TREES),
    """decided AS (
  SELECT f.*, s.activity, s.risk_multiplier, d.decision
  FROM features f LEFT JOIN signals s USING ("user") LEFT JOIN decisions d USING ("user")
)""",
    s.THREATS,
)


@query(
    "log_risk_with_model",
    sql=fs.recursive(
        s.sql(
            _LOG_MODEL,
            f'SELECT "user", anomaly, {s.rs(("anomaly_score", "risk_score"))}, risk_level, reason FROM threats',
        )
    ),
)
def log_risk(spark, folder):
    log = combined_log(spark, folder)
    model = flows.train_log_model(user_profiles(spark, folder))
    return rounded(
        flows.assess_log(log, model).select(
            "user", "anomaly", "anomaly_score", "risk_score", "risk_level", "reason"
        )
    )


# Numeric columns of a profile with its features, in their order; a feature that replaces
# an input of its name stands in that input's place.
_PROFILE_INPUTS = (
    "emails_sent_off_hours", "total_files_copied", "filetype_doc", "filetype_exe", "filetype_jpg",
    "filetype_pdf", "filetype_txt", "filetype_zip", "after_hours_logons", "weekend_logons",
    "logons_on_other_user_pcs", "logon_std_dev_hours", "late_hour_device_use", "total_malicious_urls",
    "missing_disconnects", "never_used_device", "above_avg_daily_counter", "risk_score_1",
    "risk_score_2", "risk_score_3", "risk_score_4", "risk_score_5", "emails_sent_per_day",
    "active_days", "unique_recipients_count", "external_emails_ratio", "attachment_count_avg",
    "bcc_usage_rate", "avg_files_copied_per_day", "after_hours_file_copy_ratio",
    "avg_malicious_urls_per_day", "avg_distinct_domains_per_day", "avg_after_hours_browsing_per_day",
    "distinct_pcs_used", "avg_daily_device_connections",
)
_PLAIN = [f for p in fixed.PILLARS.values() for f in p if f not in _PROFILE_INPUTS]
_NESTED = ("exfil_chain_score",)  # made of composites, hence last
_LATER = (*(c for c in fixed.COMPOSITES if c not in _NESTED), *fixed.CHAINS, *_NESTED)
_ENGINEERED = (*(f for f in _PLAIN if f not in _LATER), *_LATER)
_PROFILE_MODEL_COLUMNS = (*_PROFILE_INPUTS, *_ENGINEERED)
_REPLACED = {f for p in fixed.PILLARS.values() for f in p}


def _imputed(column: str) -> str:
    if column == "after_hours_intensity":
        return f"CAST(0 AS DOUBLE) AS {column}"  # not in these profiles
    table = "s" if column in _REPLACED else "p"
    middle = f"(SELECT quantile_cont({column}, 0.5) FROM {'scaled' if table == 's' else 'profile'})"
    return f"coalesce({table}.{column}, {middle}) AS {column}"


_PROFILE_MODEL = (
    *s.SCALED_PARTS,
    f"""imputed AS (SELECT "user", {', '.join(map(_imputed, _PROFILE_MODEL_COLUMNS))}
  FROM scaled s JOIN profile p USING ("user"))""",
    *fs.model("imputed", _PROFILE_MODEL_COLUMNS, _TREES),
    'decisions AS (SELECT "user", score - bound AS iforest_score FROM model_scores, cutoff)',
    """modelled AS (
  SELECT s.* EXCLUDE (iforest_score), d.iforest_score FROM scaled s JOIN decisions d USING ("user")
)""",
    s.TIERS.replace("FROM scaled)", "FROM modelled)").replace("FROM scaled ", "FROM modelled "),
    s.TOTAL, s.BASE,
    f"""blended AS (
  SELECT *, {s.minmax('(-iforest_score)', 'base')} * 100 AS anomaly_model_score FROM base
)""",
    """final AS (
  SELECT *, least(100, greatest(0, 0.7 * base_risk_score + 0.3 * anomaly_model_score))
    AS final_risk_score FROM blended
)""",
    s.BUCKETS, s.INDICATORS,
)


@query(
    "profile_risk_with_model",
    sql=fs.recursive(
        s.sql(
            _PROFILE_MODEL,
            'SELECT "user", CASE WHEN iforest_score < 0 THEN -1 ELSE 1 END AS iforest_prediction,'
            f" {s.r('iforest_score', 'iforest_raw_score')},"
            f" {s.rs(('base_risk_score', 'anomaly_model_score', 'final_risk_score'))},"
            " risk_tier, risk_indicators FROM explained",
        )
    ),
)
def profile_risk(spark, folder):
    profile = materialize(user_profiles(spark, folder).drop("anomaly_score", "iforest_score"))
    features = materialize(profiles.profile_features(profile))
    model = flows.train_profile_model(features)
    return rounded(
        flows.assess_features(features, model).select(
            "user", "iforest_prediction", "iforest_raw_score", "base_risk_score",
            "anomaly_model_score", "final_risk_score", "risk_tier", "risk_indicators",
        )
    )


# --- around the forest ----------------------------------------------------------------


@query(
    "snk_6_model_tables",
    sql=s.sql(
        s.LOG_PARTS,
        " UNION ALL ".join(
            f"SELECT {i} AS position, '{c}' AS feature, round(avg({c}), 6) + 0.0 AS mean,"
            f" round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) + 0.0"
            " AS scale FROM features"
            for i, c in enumerate(s.ALL36)
        ),
    ),
)
def model_tables(spark, folder):
    """The stored scaler; the stored forest is read back by ``src_4_load_model``."""
    path = scratch_path(spark, "scaler")
    features = _log_features(spark, folder)
    statistics.Scaler.fit(features, fixed.LOG_FEATURES).table(spark).write.parquet(path)
    loaded = statistics.Scaler.from_table(spark.read.parquet(path))
    return rounded(loaded.table(spark))


_DECIDED = (*s.LOG_PARTS, s.SIGNALS, s.DECIDED)


@query(
    "mdl_4_contamination_threshold",
    sql=s.sql(
        _DECIDED,
        "SELECT 'decision' AS column_name, CAST(0.05 AS DOUBLE) AS p,"
        " round(quantile_cont(decision, 0.05), 6) + 0.0 AS value FROM decided",
    ),
)
def contamination_threshold(spark, folder):
    decided = materialize(decided_features(spark, folder).select("user", "decision"))
    return rounded(statistics.quantile_table(decided, {"decision": [fixed.CONTAMINATION]}))


@query(
    "mdl_5_suspicion",
    sql=s.sql(
        PREDICTION_PARTS,
        f'SELECT "user", {s.r("iforest_anomaly_score", "suspicion")} FROM predictions',
    ),
)
def suspicion(spark, folder):
    decided = materialize(decided_features(spark, folder).select("user", "decision"))
    return rounded(forest.suspicion(decided, "decision", "suspicion").drop("decision"))


@query("mdl_6_prediction_table", sql=s.sql(PREDICTION_PARTS, PREDICTION_SELECT))
def prediction_table(spark, folder):
    return rounded(predictions(spark, folder))


@query(
    "mdl_7_rounded_suspicion",
    sql=s.sql(s.THREAT_PARTS, f'SELECT "user", {s.r("anomaly_score")} FROM flagged'),
)
def rounded_suspicion(spark, folder):
    decided = materialize(decided_features(spark, folder).select("user", "decision"))
    return rounded(forest.rounded_suspicion(decided, "decision").drop("decision"))


# --- evaluation -------------------------------------------------------------------------

_CELLS = f"""cells AS (
  SELECT {s.n('label = 1 AND anomaly = 1')} AS tp, {s.n('label = 0 AND anomaly = 1')} AS fp,
    {s.n('label = 1 AND anomaly = 0')} AS fn, {s.n('label = 0 AND anomaly = 0')} AS tn,
    CAST(sum(label) AS BIGINT) AS actual, CAST(sum(anomaly) AS BIGINT) AS predicted
  FROM flagged
)"""
_EVALUATED = (*s.THREAT_PARTS, _CELLS)


def _labelled(spark, folder):
    decided = decided_features(spark, folder).select("user", "label", "decision")
    return with_expressions(decided, {"anomaly": "if(decision < 0, 1, 0)"})


@query(
    "evl_1_prediction_report",
    sql=s.sql(
        [*_EVALUATED, """rates AS (
          SELECT *, tp / (predicted + 1e-9) AS precision, tp / (actual + 1e-9) AS recall FROM cells
        )"""],
        "SELECT actual, predicted, tp, fp, fn, {}, {}, {} FROM rates".format(
            s.r("precision"), s.r("recall"),
            s.r("2 * precision * recall / (precision + recall + 1e-9)", "f1"),
        ),
    ),
)
def prediction_report(spark, folder):
    return rounded(evaluation.prediction_report(predictions(spark, folder)))


@query(
    "evl_2_classification_metrics",
    sql=s.sql(
        _EVALUATED,
        """SELECT round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy,
        round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
        round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
        round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1_score
        FROM cells""",
    ),
)
def classification_metrics(spark, folder):
    return rounded(evaluation.classification_metrics(_labelled(spark, folder)).drop("roc_auc"))


@query(
    "evl_3_confusion_matrix",
    sql=s.sql(
        _EVALUATED,
        """SELECT 0 AS label, 0 AS predicted, tn AS n FROM cells UNION ALL
        SELECT 0, 1, fp FROM cells UNION ALL SELECT 1, 0, fn FROM cells
        UNION ALL SELECT 1, 1, tp FROM cells""",
    ),
)
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(_labelled(spark, folder))


@query(
    "evl_4_roc_auc",
    sql=s.sql(
        _EVALUATED,
        """SELECT round((tp / nullif(CAST(tp + fn AS DOUBLE), 0)
        + tn / nullif(CAST(tn + fp AS DOUBLE), 0)) / 2, 6) AS roc_auc FROM cells""",
    ),
)
def roc_auc(spark, folder):
    return rounded(evaluation.classification_metrics(_labelled(spark, folder)).select("roc_auc"))


_OWN_FLAGS = (*_LOG_MODEL, """labelled AS (
  SELECT t.anomaly, l.label FROM threats t
  JOIN (SELECT "user", max(label) AS label FROM log GROUP BY "user") l USING ("user")
)""", _CELLS.replace("FROM flagged", "FROM labelled"))


def _evaluation(spark, folder, table):
    """Of the model's own flags on the labelled log."""
    log = combined_log(spark, folder)
    model = flows.train_log_model(user_profiles(spark, folder))
    return rounded(flows.evaluate_threats(log, flows.assess_log(log, model))[table])


@query(
    "evl_2_metrics_of_model",
    sql=fs.recursive(
        s.sql(
            _OWN_FLAGS,
            """SELECT round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy,
            round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS precision,
            round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS recall,
            round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1_score,
            round((tp / nullif(CAST(tp + fn AS DOUBLE), 0)
              + tn / nullif(CAST(tn + fp AS DOUBLE), 0)) / 2, 6) AS roc_auc
            FROM cells""",
        )
    ),
)
def metrics_of_model(spark, folder):
    return _evaluation(spark, folder, "metrics")


@query(
    "evl_3_confusion_of_model",
    sql=fs.recursive(
        s.sql(
            _OWN_FLAGS,
            """SELECT 0 AS label, 0 AS predicted, tn AS n FROM cells UNION ALL
            SELECT 0, 1, fp FROM cells UNION ALL SELECT 1, 0, fn FROM cells
            UNION ALL SELECT 1, 1, tp FROM cells""",
        )
    ),
)
def confusion_of_model(spark, folder):
    return _evaluation(spark, folder, "confusion")


@query(
    "evl_labels_per_user",
    sql=s.sql([s.LOG], 'SELECT "user", max(label) AS label FROM log GROUP BY "user"'),
)
def labels_per_user(spark, folder):
    return evaluation.labels_per_user(combined_log(spark, folder))
