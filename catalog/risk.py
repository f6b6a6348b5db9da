"""SCR-1..13, JON-5..8 and AGG-11: scores, levels, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden.functions import clip, with_expressions
from driftwarden.operators import logs, profiles, scoring, statistics
from driftwarden.plans import flows
from driftwarden.session import materialize
from driftwarden.sources.events import user_profiles

from . import sql as s
from .inputs import PREDICTION_PARTS, THREAT_SELECT
from .registry import query, rounded
from .stand_ins import decided_features, predictions

_TIER_COLUMNS = tuple(f"score_tier_{t}" for t in s.WEIGHTS)


def _features(spark, folder):
    """Profile features, with the stand-in score of the profile table."""
    return materialize(profiles.profile_features(materialize(user_profiles(spark, folder))))


def _final(spark, folder, anomaly=None):
    base = scoring.base_risk(scoring.tier_scores(_features(spark, folder)))
    return scoring.blend_anomaly(base, anomaly)


# --- profile flow ----------------------------------------------------------------


@query(
    "scr_1_tier_scores",
    sql=s.sql([*s.SCALED_PARTS, s.TIERS], f'SELECT "user", {s.rs(_TIER_COLUMNS)} FROM tiers'),
)
def tier_scores(spark, folder):
    scored = scoring.tier_scores(_features(spark, folder))
    return rounded(scored.select("user", *_TIER_COLUMNS))


@query(
    "scr_2_base_risk",
    sql=s.sql(s.BASE_PARTS, f'SELECT "user", {s.r("base_risk_score")} FROM base'),
)
def base_risk(spark, folder):
    scored = scoring.base_risk(scoring.tier_scores(_features(spark, folder)))
    return rounded(scored.select("user", "base_risk_score"))


_BLEND = ("base_risk_score", "anomaly_model_score", "final_risk_score")


@query(
    "scr_3_blended_risk",
    sql=s.sql([*s.BASE_PARTS, s.BLENDED_FINAL], f'SELECT "user", {s.rs(_BLEND)} FROM final'),
)
def blended_risk(spark, folder):
    return rounded(_final(spark, folder, "iforest_score").select("user", *_BLEND))


@query(
    "scr_4_risk_buckets",
    sql=s.sql(
        s.BUCKET_PARTS,
        'SELECT "user", risk_tier, {} FROM buckets'.format(
            s.rs(("final_risk_score", "medium_threshold", "high_threshold"))
        ),
    ),
)
def risk_buckets(spark, folder):
    return rounded(
        scoring.bucket(_final(spark, folder)).select(
            "user", "risk_tier", "final_risk_score", "medium_threshold", "high_threshold"
        )
    )


@query(
    "scr_5_indicator_texts",
    sql=s.sql(s.EXPLAINED_PARTS, 'SELECT "user", risk_indicators FROM explained'),
)
def indicator_texts(spark, folder):
    explained = scoring.explain_indicators(_features(spark, folder))
    return explained.select("user", "risk_indicators")


@query(
    "agg_11_score_percentiles",
    sql=s.sql(
        s.BUCKET_PARTS, f"SELECT {s.rs(('medium_threshold', 'high_threshold'))} FROM cuts"
    ),
)
def score_percentiles(spark, folder):
    cuts = statistics.quantile_table(_final(spark, folder), {"final_risk_score": (0.7, 0.9)})
    return rounded(
        cuts.agg(
            F.max(F.when(F.col("p") == 0.7, F.col("value"))).alias("medium_threshold"),
            F.max(F.when(F.col("p") == 0.9, F.col("value"))).alias("high_threshold"),
        )
    )


# --- log flow --------------------------------------------------------------------

_DECIDED = (*s.LOG_PARTS, s.SIGNALS, s.DECIDED)


@query(
    "scr_6_rule_score",
    sql=s.sql(s.LOG_PARTS, f'SELECT "user", {s.r(s.RULE, "rule_score")} FROM features'),
)
def rule_score(spark, folder):
    features = decided_features(spark, folder)
    return rounded(
        features.selectExpr("`user`", f"{scoring.rule_score(features.columns)} as rule_score")
    )


@query(
    "scr_7_activity_boost",
    sql=s.sql(_DECIDED, f'SELECT "user", CAST({s.BOOST} AS DOUBLE) AS boost FROM decided'),
)
def activity_boost(spark, folder):
    features = decided_features(spark, folder)
    return rounded(
        features.selectExpr("`user`", f"{scoring.activity_boost(features.columns)} as boost")
    )


def _ruled(spark, folder):
    df = decided_features(spark, folder)
    present = df.columns
    return with_expressions(
        df,
        {
            "rule_score": f"{scoring.rule_score(present)} + {scoring.activity_boost(present)}",
            "anomaly": "if(decision < 0, 1, 0)",
        },
    )


@query(
    "scr_8_anomaly_floor",
    sql=s.sql(s.THREAT_PARTS, f'SELECT "user", anomaly, {s.r("with_floor")} FROM floored'),
)
def anomaly_floor(spark, folder):
    floor = scoring.anomaly_floor("rule_score", "anomaly")
    return rounded(_ruled(spark, folder).selectExpr("`user`", "anomaly", f"{floor} as with_floor"))


@query(
    "scr_9_multiplier_floor",
    sql=s.sql(
        s.THREAT_PARTS,
        'SELECT "user", round(CASE WHEN risk_multiplier >= 2.0 THEN greatest(rule_score, 85)'
        " ELSE rule_score END, 6) + 0.0 AS with_floor FROM flagged",
    ),
)
def multiplier_floor(spark, folder):
    floor = scoring.multiplier_floor("rule_score", "risk_multiplier")
    return rounded(_ruled(spark, folder).selectExpr("`user`", f"{floor} as with_floor"))


@query(
    "scr_10_fixed_levels",
    sql=s.sql(
        s.THREAT_PARTS,
        f"""SELECT "user", {s.r('risk_score')}, {s.LEVEL} AS risk_level FROM (
          SELECT "user", least(100, greatest(0, rule_score)) AS risk_score FROM flagged)""",
    ),
)
def fixed_levels(spark, folder):
    clipped = _ruled(spark, folder).selectExpr(
        "`user`", f"{clip('rule_score', 0.0, 100.0)} as risk_score"
    )
    return rounded(with_expressions(clipped, {"risk_level": scoring.risk_level("risk_score")}))


@query("scr_11_reasons", sql=s.sql(s.LOG_PARTS, f'SELECT "user", {s.REASON} AS reason FROM features'))
def reasons(spark, folder):
    features = decided_features(spark, folder)
    return features.selectExpr("`user`", f"{scoring.reasons(features.columns)} as reason")


@query("scr_13_analyze_threats", sql=s.sql(s.THREAT_PARTS, THREAT_SELECT))
def analyze_threats(spark, folder):
    threats = flows.analyze_threats(decided_features(spark, folder), decision="decision")
    return rounded(
        threats.select("user", "anomaly_score", "risk_score", "risk_level", "reason")
    )


# --- joins of results --------------------------------------------------------------


@query(
    "jon_5_join_predictions",
    sql=s.sql(
        PREDICTION_PARTS,
        f"""SELECT "user", email_count, iforest_prediction, is_anomaly,
        {s.rs(('iforest_raw_score', 'iforest_anomaly_score'))}
        FROM features LEFT JOIN predictions USING ("user")""",
    ),
)
def join_predictions(spark, folder):
    features = decided_features(spark, folder).select("user", "email_count")
    found = predictions(spark, folder).drop("ground_truth_label")
    return rounded(logs.join_left(features, found))


@query(
    "jon_6_scores_on_features",
    sql=s.sql(
        s.EXPLAINED_PARTS,
        f'SELECT "user", {s.rs(("ext_email_ratio", "final_risk_score"))}, risk_tier,'
        " risk_indicators FROM explained",
    ),
)
def scores_on_features(spark, folder):
    scored = scoring.score_profiles(_features(spark, folder))
    kept = scored.drop("medium_threshold", "high_threshold")
    return rounded(
        kept.select("user", "ext_email_ratio", "final_risk_score", "risk_tier", "risk_indicators")
    )


@query(
    "jon_7_columns_side_by_side",
    sql=s.sql(
        s.PILLAR_PARTS,
        f"""SELECT "user", {s.rs(('email_exfil_composite', 'file_staging_composite',
        'temporal_anomaly_composite', 'network_anomaly_composite', 'device_anomaly_composite'))}
        FROM pillars""",
    ),
)
def side_by_side(spark, folder):
    table = profiles.ProfileFeatures(materialize(user_profiles(spark, folder))).table()
    return rounded(
        table.select(
            "user", "email_exfil_composite", "file_staging_composite",
            "temporal_anomaly_composite", "network_anomaly_composite", "device_anomaly_composite",
        )
    )


@query(
    "jon_8_statistics_on_every_row",
    sql=s.sql(
        s.PROFILE_PARTS,
        'SELECT "user", {}, {} FROM profile'.format(
            s.r("weekend_logons - (SELECT avg(weekend_logons) FROM profile)", "above_mean"),
            s.r("weekend_logons / (SELECT max(weekend_logons) FROM profile)", "of_max"),
        ),
    ),
)
def statistics_on_rows(spark, folder):
    profile = materialize(user_profiles(spark, folder))
    stats = statistics.summarize(profile, ["weekend_logons"], ("mean", "hi"))["weekend_logons"]
    return rounded(
        profile.selectExpr(
            "`user`",
            f"weekend_logons - {stats['mean']!r}D as above_mean",
            f"weekend_logons / {stats['hi']!r}D as of_max",
        )
    )
