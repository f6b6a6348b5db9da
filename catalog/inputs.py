"""SRC, SNK and SCH: reading, writing, and shaping of input tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import fixed
from driftwarden.operators import logs, profiles, reports, schema
from driftwarden.plans import flows
from driftwarden.session import materialize, scratch_path
from driftwarden.sources import tables
from driftwarden.sources.events import combined_log, kind_logs, user_profiles

from . import sql as s
from .registry import query, rounded
from .stand_ins import decided_features, predictions

_PROFILE_SELECT = 'SELECT "user", label, {} FROM profile'.format(
    ", ".join(
        c if c in ("never_used_device", "missing_disconnects") else s.r(c)
        for c in s.PROFILE_COLUMNS
    )
)


def _profile_columns(df):
    return rounded(df.select("user", "label", *s.PROFILE_COLUMNS))


def _round_trip(df, label, suffix=".csv"):
    return tables.write_table(df, scratch_path(df.sparkSession, label) + suffix)


# --- sources -------------------------------------------------------------------


@query(
    "src_1_read_profile",
    sql=s.sql(s.PROFILE_PARTS, _PROFILE_SELECT.replace("label,", "CAST(label AS BIGINT) AS label,")),
)
def read_profile(spark, folder):
    profile = user_profiles(spark, folder)
    path = _round_trip(profile, "profile")
    return _profile_columns(tables.read_profile(spark, path, profile.columns))


@query(
    "src_2_read_logs",
    sql=s.sql(
        [s.LOG],
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, count(*) AS row_count, count(\"user\") AS users_given,"
            f" count({column}) AS values_given, {s.n(s.OFF)} AS after_hours FROM log"
            for kind, column in (
                ("email", '"to"'), ("logon", "activity"), ("file", "file_name"),
                ("device", "device"), ("combined", "activity"),
            )
        ),
    ),
)
def read_logs(spark, folder):
    sources = {**kind_logs(spark, folder), "combined": combined_log(spark, folder)}
    counted = {"email": "to", "logon": "activity", "file": "file_name", "device": "device",
               "combined": "activity"}
    results = None
    for kind, log in sources.items():
        path = _round_trip(log.select(*tables.LOG_COLUMNS[kind]), kind)
        part = tables.read_log(spark, path, kind).selectExpr(
            f"'{kind}' as kind", "count(*) as row_count", "count(`user`) as users_given",
            f"count(`{counted[kind]}`) as values_given",
            f"count_if({logs.after_hours('date')}) as after_hours",
        )
        results = part if results is None else results.unionByName(part)
    return results


_TRAINING_SQL_COLUMNS = ", ".join(
    s.r(c) if not c.endswith("_spike") else c for c in s.ALL36
)
TRAINING = """training AS (
  SELECT "user", label, emails_sent_per_day AS email_count,
    unique_recipients_count AS recipient_count,
    CAST(trunc(external_emails_ratio * emails_sent_per_day) AS DOUBLE) AS external_count,
    emails_sent_off_hours AS late_night_count, 0 AS weekend_count,
    external_emails_ratio AS external_ratio,
    emails_sent_off_hours / (emails_sent_per_day + 1) AS late_night_ratio, 0 AS weekend_ratio,
    after_hours_logons + weekend_logons AS login_count, after_hours_logons AS late_logins,
    weekend_logons AS weekend_logins, after_hours_logons AS after_hours_logins,
    0 AS failed_logins,
    after_hours_logons / (after_hours_logons + weekend_logons + 1) AS late_login_ratio,
    weekend_logons / (after_hours_logons + weekend_logons + 1) AS weekend_login_ratio,
    after_hours_logons / (after_hours_logons + weekend_logons + 1) AS after_hours_ratio,
    total_files_copied AS file_access_count, total_files_copied AS file_copy_count,
    filetype_pdf + filetype_doc AS sensitive_file_access,
    after_hours_file_copy_ratio * total_files_copied AS after_hours_file_access,
    0 AS weekend_file_access, 1 AS copy_ratio,
    (filetype_pdf + filetype_doc) / (total_files_copied + 1) AS sensitive_ratio,
    after_hours_file_copy_ratio AS after_hours_file_ratio,
    avg_daily_device_connections AS device_activity_count,
    avg_daily_device_connections AS usb_insertions, never_used_device AS unknown_device_count,
    late_hour_device_use AS after_hours_device_usage, 0 AS weekend_device_usage,
    avg_daily_device_connections / (avg_daily_device_connections + 1) AS usb_ratio,
    never_used_device / (avg_daily_device_connections + 1) AS unknown_device_ratio,
    late_hour_device_use / (avg_daily_device_connections + 1) AS after_hours_device_ratio
  FROM profile
), trained AS (
  SELECT *,
    CAST(email_count > (SELECT quantile_cont(email_count, 0.95) FROM training) AS INTEGER)
      AS email_spike,
    CAST(login_count > (SELECT quantile_cont(login_count, 0.95) FROM training) AS INTEGER)
      AS login_spike,
    CAST(file_access_count > (SELECT quantile_cont(file_access_count, 0.95) FROM training)
      AS INTEGER) AS file_spike,
    CAST(device_activity_count > (SELECT quantile_cont(device_activity_count, 0.95) FROM training)
      AS INTEGER) AS device_spike
  FROM training
)"""
TRAINING_PARTS = (*s.PROFILE_PARTS, TRAINING)


def _as_double(df):
    """Counts as doubles, as the training table stores them."""
    return rounded(
        df.selectExpr(
            "`user`", "label",
            *[c if c.endswith("_spike") else f"cast({c} as double) as {c}" for c in s.ALL36],
        )
    )


_TRAINED_SELECT = f'SELECT "user", label, {_TRAINING_SQL_COLUMNS} FROM trained'


@query("src_3_read_training_table", sql=s.sql(TRAINING_PARTS, _TRAINED_SELECT))
def read_training(spark, folder):
    training = profiles.training_layout(materialize(user_profiles(spark, folder)))
    return _as_double(tables.read_features(spark, _round_trip(training, "training"), label=True))


# --- sinks ---------------------------------------------------------------------

_FEATURE_COLUMNS = (
    "ext_email_ratio", "off_hours_email_ratio", "email_exfil_composite", "exfil_chain_score",
    "lateral_movement_score", "network_file_chain", "bcc_usage_rate", "total_files_copied",
)


@query(
    "snk_1_write_features",
    sql=s.sql(s.SCALED_PARTS, f'SELECT "user", {s.rs(_FEATURE_COLUMNS)} FROM scaled'),
)
def write_features(spark, folder):
    features = profiles.profile_features(materialize(user_profiles(spark, folder)))
    path = _round_trip(features, "features", ".parquet")
    return rounded(tables.read_table(spark, path).select("user", *_FEATURE_COLUMNS))


PREDICTIONS = f"""predictions AS (
  SELECT "user", label AS ground_truth_label, decision AS iforest_raw_score,
    CASE WHEN decision < 0 THEN -1 ELSE 1 END AS iforest_prediction,
    CAST(decision < 0 AS INTEGER) AS is_anomaly,
    {s.minmax('(-decision)', 'decided')} * 100 AS iforest_anomaly_score
  FROM decided
)"""
PREDICTION_PARTS = (*s.LOG_PARTS, s.SIGNALS, s.DECIDED, PREDICTIONS)
PREDICTION_SELECT = (
    'SELECT "user", iforest_prediction, is_anomaly, ground_truth_label, '
    f"{s.rs(('iforest_raw_score', 'iforest_anomaly_score'))} FROM predictions"
)


@query("snk_2_write_predictions", sql=s.sql(PREDICTION_PARTS, PREDICTION_SELECT))
def write_predictions(spark, folder):
    path = _round_trip(predictions(spark, folder), "predictions", ".parquet")
    return rounded(tables.read_table(spark, path))


@query(
    "snk_3_write_scored_users",
    sql=s.sql(
        s.EXPLAINED_PARTS,
        f'SELECT "user", {s.r("final_risk_score")}, risk_tier, risk_indicators FROM explained',
    ),
)
def write_scored(spark, folder):
    scored = flows.assess_profiles(user_profiles(spark, folder))
    path = _round_trip(scored.drop("medium_threshold", "high_threshold"), "scored", ".parquet")
    return rounded(
        tables.read_table(spark, path).select(
            "user", "final_risk_score", "risk_tier", "risk_indicators"
        )
    )


@query("snk_4_write_training_table", sql=s.sql(TRAINING_PARTS, _TRAINED_SELECT))
def write_training(spark, folder):
    training = profiles.training_layout(materialize(user_profiles(spark, folder)))
    return _as_double(tables.read_table(spark, _round_trip(training, "training", ".parquet")))


THREAT_SELECT = (
    f'SELECT "user", {s.rs(("anomaly_score", "risk_score"))}, risk_level, reason FROM threats'
)


@query("snk_5_export_threats", sql=s.sql(s.THREAT_PARTS, THREAT_SELECT))
def export_threats(spark, folder):
    threats = flows.analyze_threats(decided_features(spark, folder), decision="decision")
    path = _round_trip(threats.select(*reports.RESULT_COLUMNS), "threat_report")
    read = tables.read_table(
        spark, path,
        "user string, anomaly_score double, risk_score double, risk_level string, reason string",
    )
    return rounded(read)


# --- schema operators ----------------------------------------------------------


def _raw_inputs(spark, folder):
    """The four logs under the column names of their sources."""
    named = {
        "email": {"user": "User_ID", "date": "Timestamp", "to": " Recipient "},
        "logon": {"user": "EmpID", "date": "DateTime", "activity": "Activity"},
        "file": {"user": "employee_id", "date": "time", "file_name": "FileName",
                 "activity": "Activity"},
        "device": {"user": "userid", "date": "DATE", "device": "usb_device"},
    }
    return {k: l.withColumnsRenamed(named[k]) for k, l in kind_logs(spark, folder).items()}


@query(
    "sch_1_canonical_names",
    sql=s.sql([s.LOG], 'SELECT "user", "to", CAST(h AS INTEGER) AS h FROM log'),
)
def canonical_names(spark, folder):
    log = schema.canonical_names(_raw_inputs(spark, folder)["email"])
    return log.selectExpr("`user`", "`to`", "hour(date) as h")


@query(
    "sch_2_route_by_kind",
    sql=s.sql(
        [s.LOG],
        """SELECT 'email' AS kind, count(*) AS row_count, count(DISTINCT "user") AS users FROM log
        UNION ALL SELECT 'logon', count(*), count(DISTINCT "user") FROM log
        UNION ALL SELECT 'file', count(*), count(DISTINCT "user") FROM log
        UNION ALL SELECT 'device', count(*), count(DISTINCT "user") FROM log""",
    ),
)
def route_by_kind(spark, folder):
    routed = schema.route(_raw_inputs(spark, folder).values())
    tagged = [l.selectExpr(f"'{k}' as kind", "`user`") for k, l in routed.items()]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("kind").agg(
        F.count("*").alias("row_count"), F.count_distinct("user").alias("users")
    )


@query(
    "sch_3_validate_rows",
    sql=s.sql(
        [s.LOG],
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, count(*) AS row_count, {s.n('k = 7')} AS null_users,"
            f" {s.n('k = 8')} AS bad_dates FROM log"
            for kind in fixed.LOG_KINDS
        ),
    ),
)
def validate_rows(spark, folder):
    log = combined_log(spark, folder).selectExpr(
        "if(k = 7, null, `user`) as `user`",
        "if(k = 8, 'not a date', cast(date as string)) as date",
        "`to`", "activity", "file_name", "device",
    )
    kinds = {k: log.select(*fixed.REQUIRED_COLUMNS[k]) for k in fixed.LOG_KINDS}
    return schema.row_problems(kinds)


_BAD = """SELECT 'logon' AS kind, "user", 'not a date' AS "date" FROM log WHERE k = 8"""


@query("sch_3_bad_dates_with_format", sql=s.sql([s.LOG], _BAD))
def bad_dates(spark, folder):
    """Dates in a format of their own, read from CSV without failing."""
    form = "MM/dd/yyyy HH:mm:ss"
    log = combined_log(spark, folder).selectExpr(
        "`user`", f"if(k = 8, 'not a date', date_format(date, '{form}')) as date", "activity"
    )
    read = tables.read_log(spark, _round_trip(log, "dated"), "logon", strict=False, date_format=form)
    return schema.bad_dates({"logon": read}, form)


@query(
    "sch_3_validate_rows_with_format",
    sql=s.sql(
        [s.LOG],
        f"SELECT 'logon' AS kind, count(*) AS row_count, {s.n('k = 7')} AS null_users,"
        f" {s.n('k = 8')} AS bad_dates FROM log",
    ),
)
def validate_rows_with_format(spark, folder):
    form = "MM/dd/yyyy HH:mm:ss"
    log = combined_log(spark, folder).selectExpr(
        "if(k = 7, null, `user`) as `user`",
        f"if(k = 8, 'not a date', date_format(date, '{form}')) as date", "activity",
    )
    read = tables.read_log(spark, _round_trip(log, "dated"), "logon", strict=False, date_format=form)
    return schema.row_problems({"logon": read}, form)


_FEATURES_SELECT = f'SELECT "user", {s.features(s.ALL36)} FROM features'


@query("sch_4_build_every_kind", sql=s.sql(s.LOG_PARTS, _FEATURES_SELECT))
def build_every_kind(spark, folder):
    return rounded(logs.log_features(combined_log(spark, folder)))


@query("sch_2_route_combined", sql=s.sql(s.LOG_PARTS, _FEATURES_SELECT))
def route_combined(spark, folder):
    """A combined log, routed, gives the features of its four parts."""
    return rounded(logs.log_features(schema.route([combined_log(spark, folder)])))


@query("sch_5_ready_features", sql=s.sql(s.LOG_PARTS, _FEATURES_SELECT))
def ready_features(spark, folder):
    ready = logs.log_features(kind_logs(spark, folder))
    return rounded(logs.log_features(ready))


@query(
    "sch_6_missing_columns",
    sql=s.sql(
        s.LOG_PARTS,
        'SELECT "user", login_count, failed_logins, 0 AS email_count, 0 AS usb_insertions,'
        " 0 AS file_spike FROM features",
    ),
)
def missing_columns(spark, folder):
    only = logs.kind_features(kind_logs(spark, folder)["logon"], "logon")
    return schema.add_missing(only).select(
        "user", "login_count", "failed_logins", "email_count", "usb_insertions", "file_spike"
    )


@query("sch_7_model_columns", sql=s.sql(s.LOG_PARTS, _FEATURES_SELECT))
def model_columns(spark, folder):
    return rounded(schema.model_columns(logs.log_features(kind_logs(spark, folder))))


@query(
    "sch_8_align_to_trained",
    sql=s.sql(
        s.PROFILE_PARTS,
        f"""SELECT "user", {s.r('weekend_logons')}, CAST(0 AS DOUBLE) AS not_in_data, {s.r('active_days')},
        'not_in_data' AS missing FROM profile""",
    ),
)
def align(spark, folder):
    trained = ["weekend_logons", "not_in_data", "active_days"]
    aligned, missing, _ = schema.align_to(user_profiles(spark, folder), trained)
    return aligned.withColumn("missing", F.lit(", ".join(missing)))


@query(
    "sch_9_synthetic_user",
    sql="SELECT count(*) AS row_count, count(DISTINCT event_id) AS distinct_users,"
    " CAST(min(0) AS BIGINT) AS first_user, count(*) - 1 AS last_user, true AS same_when_moved FROM events",
)
def synthetic_user(spark, folder):
    """The ids are 0..n-1, and stay with their rows when these are partitioned otherwise."""
    anonymous = combined_log(spark, folder).drop("user")

    def fingerprint(df):
        rest = [c for c in df.columns if c != "user"]
        digest = f"sum(cast(xxhash64(`user`, {', '.join(f'`{c}`' for c in rest)}) as decimal(38, 0)))"
        return df.agg(
            F.count("*").alias("row_count"), F.count_distinct("user").alias("distinct_users"),
            F.expr("min(cast(`user` as bigint)) as first_user"),
            F.expr("max(cast(`user` as bigint)) as last_user"), F.expr(f"{digest} as digest"),
        )

    one = fingerprint(schema.ensure_user(anonymous))
    other = fingerprint(schema.ensure_user(anonymous.repartition(23))).select(F.col("digest").alias("moved"))
    return one.crossJoin(F.broadcast(other)).selectExpr(
        "row_count", "distinct_users", "first_user", "last_user", "digest = moved as same_when_moved"
    )


@query(
    "sch_10_keep_engineered",
    sql=s.sql(
        s.PROFILE_PARTS,
        'SELECT "user", round(coalesce(bcc_usage_rate, 0), 6) + 0.0 AS bcc_usage_rate FROM profile',
    ),
)
def keep_engineered(spark, folder):
    profile = user_profiles(spark, folder).select("user", "bcc_usage_rate")
    return rounded(schema.keep_last(profile, {"bcc_usage_rate": "coalesce(bcc_usage_rate, 0D)"}))


@query(
    "sch_11_numeric_features",
    sql=s.sql(
        s.PROFILE_PARTS,
        "SELECT count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE SELECT * FROM profile)"
        " WHERE column_type IN ('DOUBLE', 'BIGINT', 'INTEGER') AND column_name <> 'label') AS feature_count"
        " FROM profile",
    ),
)
def numeric_features(spark, folder):
    profile = user_profiles(spark, folder)
    names = schema.numeric_features(profile)
    return profile.select(*names).agg(F.count("*").alias("row_count")).withColumn(
        "feature_count", F.lit(len(names)).cast("long")
    )


@query(
    "sch_12_drop_identity",
    sql=s.sql(s.LOG_PARTS, f"SELECT {s.features(s.LOGON)} FROM features"),
)
def drop_identity(spark, folder):
    features = logs.kind_features(kind_logs(spark, folder)["logon"], "logon")
    return rounded(schema.drop_identity(features))


@query(
    "sch_13_column_or_zero",
    sql=s.sql(
        s.PROFILE_PARTS,
        'SELECT "user", round(coalesce(attachment_count_avg, 0), 6) + 0.0 AS present,'
        " CAST(0 AS DOUBLE) AS absent FROM profile",
    ),
)
def column_or_zero(spark, folder):
    profile = user_profiles(spark, folder)
    present = profile.columns
    return rounded(
        profile.selectExpr(
            "`user`",
            f"{schema.column_or_zero(present, 'attachment_count_avg')} as present",
            f"{schema.column_or_zero(present, 'no_such_column')} as absent",
        )
    )


@query(
    "sch_14_null_counts",
    sql=s.sql(
        s.PROFILE_PARTS,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {s.n(f'{c} IS NULL')} AS null_count FROM profile"
            for c in s.PROFILE_COLUMNS
        ),
    ),
)
def null_counts(spark, folder):
    return schema.null_counts(user_profiles(spark, folder).select(*s.PROFILE_COLUMNS))
