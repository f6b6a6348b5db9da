"""AGG-13..18, FLT, SRT, TOP and RPT: tables that are shown to people."""

from __future__ import annotations

from driftwarden.operators import evaluation, reports, schema
from driftwarden.plans import flows
from driftwarden.session import materialize
from driftwarden.sources.events import combined_log, user_profiles

from . import sql as s
from .inputs import PREDICTION_PARTS
from .registry import query, rounded
from .stand_ins import decided_features, predictions

_SHOWN = f'"user", {s.rs(("anomaly_score", "risk_score"))}, risk_level, reason'


def _threats(spark, folder):
    return flows.analyze_threats(decided_features(spark, folder), decision="decision")


def _profiles(spark, folder):
    return flows.assess_profiles(user_profiles(spark, folder))


@query(
    "agg_13_level_distribution",
    sql=s.sql(
        s.THREAT_PARTS,
        """SELECT l.risk_level, count(t."user") AS n,
        round(100 * count(t."user") / CAST((SELECT count(*) FROM threats) AS DOUBLE), 6) AS pct
        FROM (VALUES ('High'), ('Medium'), ('Low')) l(risk_level)
        LEFT JOIN threats t USING (risk_level) GROUP BY l.risk_level""",
    ),
)
def level_distribution(spark, folder):
    return rounded(reports.level_distribution(_threats(spark, folder)))


@query(
    "agg_14_highest_user",
    sql=s.sql(
        s.THREAT_PARTS,
        f'SELECT "user", {s.r("risk_score")}, risk_level, reason FROM threats'
        ' ORDER BY threats.risk_score DESC, "user" LIMIT 1',
    ),
)
def highest_user(spark, folder):
    columns = ["user", "risk_score", "risk_level", "reason"]
    return rounded(reports.highest_row(_threats(spark, folder), columns))


_DISTRIBUTION = "SELECT {} FROM predictions".format(
    ", ".join(
        s.r(expression.format("iforest_anomaly_score"), name)
        for name, expression in {
            "min": "min({})", "max": "max({})", "mean": "avg({})", "std": "stddev_samp({})",
            "p75": "quantile_cont({}, 0.75)", "p90": "quantile_cont({}, 0.9)",
            "p95": "quantile_cont({}, 0.95)",
        }.items()
    )
)


@query("agg_15_score_distribution", sql=s.sql(PREDICTION_PARTS, _DISTRIBUTION))
def score_distribution(spark, folder):
    table = materialize(predictions(spark, folder))
    return rounded(reports.score_distribution(table, "iforest_anomaly_score"))


@query(
    "agg_16_histogram",
    sql=s.sql(
        s.THREAT_PARTS,
        """SELECT b.bin, CAST((b.bin - 1) * 5 AS DOUBLE) AS bin_from, count(t."user") AS n
        FROM (SELECT unnest(range(1, 21)) AS bin) b LEFT JOIN threats t
          ON least(CAST(floor(t.anomaly_score / 5) AS BIGINT) + 1, 20) = b.bin
        GROUP BY b.bin""",
    ),
)
def histogram(spark, folder):
    return rounded(reports.histogram(_threats(spark, folder)))


@query(
    "agg_17_label_distribution",
    sql=s.sql([s.LOG], "SELECT label, count(*) AS n FROM log GROUP BY label"),
)
def label_distribution(spark, folder):
    return evaluation.label_distribution(combined_log(spark, folder))


@query(
    "agg_18_prediction_counts",
    sql=s.sql(
        PREDICTION_PARTS,
        """SELECT count(*) AS total, count(*) FILTER (WHERE is_anomaly = 0) AS normal,
        count(*) FILTER (WHERE is_anomaly = 1) AS anomalous,
        round(100 * avg(1 - is_anomaly), 6) AS normal_pct,
        round(100 * avg(is_anomaly), 6) AS anomalous_pct FROM predictions""",
    ),
)
def prediction_counts(spark, folder):
    return rounded(reports.prediction_counts(predictions(spark, folder)))


@query(
    "flt_1_one_level",
    sql=s.sql(s.THREAT_PARTS, f"SELECT {_SHOWN} FROM threats WHERE risk_level = 'Medium'"),
)
def one_level(spark, folder):
    return rounded(
        reports.with_level(_threats(spark, folder), "Medium").select(*reports.RESULT_COLUMNS)
    )


@query(
    "flt_2_over_cut",
    sql=s.sql(s.THREAT_PARTS, f"SELECT {_SHOWN} FROM threats WHERE threats.risk_score > 70"),
)
def over_cut(spark, folder):
    return rounded(reports.over_cut(_threats(spark, folder)).select(*reports.RESULT_COLUMNS))


@query(
    "srt_1_ranked_results",
    sql=s.sql(
        s.THREAT_PARTS, f'SELECT {_SHOWN} FROM threats ORDER BY threats.risk_score DESC, "user"'
    ),
)
def ranked(spark, folder):
    return rounded(reports.ranked(_threats(spark, folder)))


@query(
    "top_1_by_risk",
    sql=s.sql(
        s.THREAT_PARTS,
        f'SELECT {_SHOWN} FROM threats ORDER BY threats.risk_score DESC, "user" LIMIT 10',
    ),
)
def top_by_risk(spark, folder):
    return rounded(reports.top(_threats(spark, folder)).select(*reports.RESULT_COLUMNS))


@query(
    "top_2_by_anomaly",
    sql=s.sql(
        PREDICTION_PARTS,
        f"""SELECT "user", {s.r('iforest_anomaly_score')}, iforest_prediction, is_anomaly
        FROM predictions ORDER BY predictions.iforest_anomaly_score DESC, "user" LIMIT 10""",
    ),
)
def top_by_anomaly(spark, folder):
    best = reports.top(predictions(spark, folder), 10, "iforest_anomaly_score")
    return rounded(
        best.select("user", "iforest_anomaly_score", "iforest_prediction", "is_anomaly")
    )


@query(
    "top_3_high_users",
    sql=s.sql(
        s.EXPLAINED_PARTS,
        f"""SELECT "user", {s.r('final_risk_score')}, risk_tier,
        substring(risk_indicators, 1, 45) AS key_indicators FROM explained
        WHERE risk_tier = 'High' ORDER BY explained.final_risk_score DESC, "user" LIMIT 20""",
    ),
)
def high_users(spark, folder):
    return rounded(reports.top_high_users(_profiles(spark, folder)))


@query(
    "top_4_high_risk_details",
    sql=s.sql(
        s.THREAT_PARTS,
        f"""SELECT {_SHOWN} FROM threats WHERE risk_level = 'High'
        ORDER BY threats.risk_score DESC, "user" """,
    ),
)
def high_risk_details(spark, folder):
    return rounded(reports.high_risk_details(_threats(spark, folder)))


@query(
    "top_5_preview",
    sql=s.sql(
        s.THREAT_PARTS,
        f'SELECT {_SHOWN} FROM threats ORDER BY threats.risk_score DESC, "user" LIMIT 5',
    ),
)
def preview(spark, folder):
    return rounded(reports.preview(reports.ranked(_threats(spark, folder))))


@query(
    "rpt_1_risk_report",
    sql=s.sql(
        s.BUCKET_PARTS,
        f"""SELECT (SELECT count(*) FROM buckets) AS total_users,
        {s.rs(('medium_threshold', 'high_threshold'))}, l.risk_tier, count(b."user") AS n,
        round(100 * count(b."user") / CAST((SELECT count(*) FROM buckets) AS DOUBLE), 6) AS pct
        FROM (VALUES ('High'), ('Medium'), ('Low')) l(risk_tier) CROSS JOIN cuts c
        LEFT JOIN (SELECT "user", risk_tier FROM buckets) b USING (risk_tier)
        GROUP BY l.risk_tier, medium_threshold, high_threshold""",
    ),
)
def risk_report(spark, folder):
    return rounded(reports.risk_report(_profiles(spark, folder)))


@query(
    "rpt_2_executive_summary",
    sql=s.sql(
        s.THREAT_PARTS,
        """SELECT count(*) AS total_users,
        count(*) FILTER (WHERE risk_level = 'High') AS high_risk,
        count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk,
        count(*) FILTER (WHERE risk_level = 'Low') AS low_risk,
        arg_min("user", (-risk_score, "user")) AS highest_user,
        round(max(risk_score), 6) AS highest_score,
        arg_min(risk_level, (-risk_score, "user")) AS highest_level,
        arg_min(reason, (-risk_score, "user")) AS highest_reason FROM threats""",
    ),
)
def executive_summary(spark, folder):
    return rounded(reports.executive_summary(_threats(spark, folder)))


@query(
    "rpt_3_data_shape",
    sql="SELECT count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE SELECT * FROM events)) AS column_count"
    " FROM events",
)
def data_shape(spark, folder):
    return schema.shape(spark.read.parquet(f"{folder}/events.parquet"))
