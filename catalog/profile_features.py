"""AGG-8..12, AGG-19, NRM, PIL, TRN and DRV over user profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import fixed
from driftwarden.operators import profiles, statistics
from driftwarden.plans import flows
from driftwarden.session import materialize, scratch_path
from driftwarden.sources import tables
from driftwarden.sources.events import user_profiles

from . import sql as s
from .inputs import TRAINING_PARTS, _as_double, _TRAINED_SELECT
from .registry import query, rounded

_SOME = ("external_emails_ratio", "weekend_logons", "attachment_count_avg", "logon_std_dev_hours")


def _profiles(spark, folder):
    return materialize(user_profiles(spark, folder))


def _per_column(select: str, columns=_SOME) -> str:
    return s.sql(
        s.PROFILE_PARTS,
        " UNION ALL ".join(select.replace("{}", c) for c in columns),
    )


# --- statistics ------------------------------------------------------------------


@query(
    "agg_8_mean_and_std",
    sql=_per_column(
        "SELECT '{}' AS column_name, CAST(count({}) AS DOUBLE) AS n, round(avg({}), 6) AS mean,"
        " round(stddev_samp({}), 6) AS sd FROM profile"
    ),
)
def mean_and_std(spark, folder):
    return rounded(statistics.summary_table(user_profiles(spark, folder), _SOME))


_QUANTILES = (0.75, 0.80, 0.85, 0.90, 0.95)


@query(
    "agg_9_quantiles",
    sql=s.sql(
        s.PROFILE_PARTS,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p,"
            f" round(quantile_cont({c}, {p}), 6) AS value FROM profile"
            for c in _SOME
            for p in _QUANTILES
        ),
    ),
)
def column_quantiles(spark, folder):
    return rounded(
        statistics.quantile_table(_profiles(spark, folder), {c: _QUANTILES for c in _SOME})
    )


@query(
    "agg_9_quantiles_narrowed",
    sql=s.sql(
        [s.LOG],
        " UNION ALL ".join(
            f"SELECT CAST({p} AS DOUBLE) AS p, round(quantile_cont(value, {p}), 6) AS value FROM log"
            for p in _QUANTILES
        ),
    ),
)
def narrowed_quantiles(spark, folder):
    """Over every event."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    found = statistics.quantiles(events, {"value": _QUANTILES})["value"]
    return rounded(spark.createDataFrame(list(found.items()), "p double, value double"))


@query(
    "agg_10_min_and_max",
    sql=_per_column(
        "SELECT '{}' AS column_name, round(min({}), 6) AS lo, round(max({}), 6) AS hi FROM profile"
    ),
)
def min_and_max(spark, folder):
    return rounded(statistics.summary_table(user_profiles(spark, folder), _SOME, ("lo", "hi")))


@query(
    "agg_12_median",
    sql=_per_column(
        "SELECT '{}' AS column_name, CAST(0.5 AS DOUBLE) AS p, round(median({}), 6) AS value FROM profile"
    ),
)
def column_medians(spark, folder):
    return rounded(statistics.quantile_table(_profiles(spark, folder), {c: [0.5] for c in _SOME}))


@query(
    "agg_19_raw_feature_summary",
    sql=_per_column(
        "SELECT '{}' AS column_name, round(avg({}), 6) AS mean, round(stddev_samp({}), 6) AS sd"
        " FROM profile",
        s.PROFILE_COLUMNS,
    ),
)
def raw_summary(spark, folder):
    return rounded(
        statistics.summary_table(user_profiles(spark, folder), s.PROFILE_COLUMNS, ("mean", "sd"))
    )


# --- normalisers -----------------------------------------------------------------


@query(
    "nrm_1_zscores",
    sql=s.sql(s.PILLAR_PARTS, f'SELECT "user", {s.rs(s.Z)} FROM first_layer'),
)
def zscores(spark, folder):
    profile = _profiles(spark, folder).fillna(0)
    return rounded(
        statistics.add_zscores(profile, fixed.PROFILE_ZSCORES).select("user", *s.Z)
    )


@query(
    "nrm_2_top_quantile_flags",
    sql=s.sql(
        s.PILLAR_PARTS,
        'SELECT "user", bcc_abuse_flag, weekend_logon_flag, after_hours_browse_flag'
        " FROM first_layer",
    ),
)
def quantile_flags(spark, folder):
    names = ("bcc_abuse_flag", "weekend_logon_flag", "after_hours_browse_flag")
    outputs = {c: fixed.PROFILE_QUANTILE_FLAGS[c] for c in names}
    return statistics.add_quantile_flags(_profiles(spark, folder), outputs).select("user", *names)


@query(
    "nrm_4_unit_range",
    sql=s.sql(
        s.PROFILE_PARTS,
        'SELECT "user", {} AS days_unit, {} AS constant_unit FROM profile'.format(
            f"round({s.minmax('active_days', 'profile')}, 6) + 0.0",
            "CAST(0 AS DOUBLE)",
        ),
    ),
)
def unit_ranges(spark, folder):
    profile = _profiles(spark, folder).withColumn("constant", F.lit(3.0))
    outputs = {"days_unit": "active_days", "constant_unit": "constant"}
    return rounded(statistics.add_unit_range(profile, outputs).select("user", *outputs))


@query(
    "nrm_5_robust_scale",
    sql=s.sql(s.SCALED_PARTS, f'SELECT "user", {s.rs(s.ROBUST)} FROM scaled'),
)
def robust_scale(spark, folder):
    features = profiles.ProfileFeatures(_profiles(spark, folder)).table()
    return rounded(statistics.robust_scale(features).select("user", *s.ROBUST))


_NO_GAPS = tuple(c for c in s.PROFILE_COLUMNS if c not in ("bcc_usage_rate", "attachment_count_avg"))


def _standard(c: str) -> str:
    mean, sd = f"(SELECT avg({c}) FROM profile)", f"(SELECT stddev_pop({c}) FROM profile)"
    return s.r(f"({c} - {mean}) / CASE WHEN {sd} = 0 THEN 1 ELSE {sd} END", c)


@query(
    "nrm_6_standard_scale",
    sql=s.sql(
        s.PROFILE_PARTS, f'SELECT "user", {", ".join(map(_standard, _NO_GAPS))} FROM profile'
    ),
)
def standard_scale(spark, folder):
    profile = _profiles(spark, folder)
    scaler = statistics.Scaler.fit(profile, _NO_GAPS)
    return rounded(scaler.transform(profile).select("user", *_NO_GAPS))


@query(
    "nrm_7_impute_medians",
    sql=s.sql(
        s.PROFILE_PARTS,
        'SELECT "user", {} FROM profile'.format(
            ", ".join(
                s.r(f"coalesce({c}, (SELECT median({c}) FROM profile))", c)
                for c in ("bcc_usage_rate", "attachment_count_avg", "active_days")
            )
        ),
    ),
)
def impute(spark, folder):
    columns = ("bcc_usage_rate", "attachment_count_avg", "active_days")
    profile = _profiles(spark, folder).select("user", *columns)
    return rounded(statistics.impute_medians(profile, columns))


@query(
    "nrm_8_training_spikes",
    sql=s.sql(
        TRAINING_PARTS,
        'SELECT "user", email_spike, login_spike, file_spike, device_spike FROM trained',
    ),
)
def training_spikes(spark, folder):
    profile = _profiles(spark, folder).selectExpr(
        "`user`", "emails_sent_per_day as email_count", "total_files_copied as file_access_count",
        "after_hours_logons + weekend_logons as login_count",
        "avg_daily_device_connections as device_activity_count",
    )
    spikes = {t: (c, fixed.TRAINING_SPIKE_QUANTILE) for t, c in fixed.TRAINING_SPIKES.items()}
    return statistics.add_quantile_flags(profile, spikes).select("user", *spikes)


# --- pillars ---------------------------------------------------------------------

_FLAGS = {
    "bcc_abuse_flag", "high_attachment_flag", "after_hours_file_spike", "weekend_logon_flag",
    "other_pc_logon_flag", "logon_erratic_flag", "malicious_url_flag", "after_hours_browse_flag",
    "multi_pc_flag", "never_used_device_flag", "lateral_movement_score",
}


def _shown(columns, scaled: bool = False) -> str:
    flags = _FLAGS - {"lateral_movement_score"} if scaled else _FLAGS
    return ", ".join(c if c in flags else s.r(c) for c in columns)


def _pillar(letter: str, name: str) -> None:
    columns = fixed.PILLARS[name]

    @query(
        f"pil_{letter}_{name}",
        sql=s.sql(s.PILLAR_PARTS, f'SELECT "user", {_shown(columns)} FROM pillars'),
    )
    def _(spark, folder):
        return rounded(profiles.pillar(_profiles(spark, folder), name))


for _letter, _name in zip("abcdef", fixed.PILLARS):
    _pillar(_letter, _name)

_ALL54 = [c for columns in fixed.PILLARS.values() for c in columns]


@query(
    "pil_g_all_features",
    sql=s.sql(s.SCALED_PARTS, f'SELECT "user", {_shown(_ALL54, scaled=True)} FROM scaled'),
)
def all_features(spark, folder):
    return rounded(profiles.profile_features(_profiles(spark, folder)).select("user", *_ALL54))


@query("trn_1_training_layout", sql=s.sql(TRAINING_PARTS, _TRAINED_SELECT))
def training_layout(spark, folder):
    return _as_double(profiles.training_layout(_profiles(spark, folder)))


# --- derived columns ---------------------------------------------------------------

_DERIVED_SQL = {
    "drv_2_after_hours_intensity": (
        "after_hours_intensity",
        "after_hours_logons + emails_sent_off_hours + avg_after_hours_browsing_per_day * active_days",
    ),
    "drv_3_file_risk_composite": (
        "file_risk_composite",
        "3 * filetype_exe + 2 * filetype_zip + 10 * after_hours_file_copy_ratio",
    ),
    "drv_4_email_exfil_score": (
        "email_exfil_score",
        "external_emails_ratio * emails_sent_per_day * attachment_count_avg",
    ),
    "drv_5_device_anomaly_score": (
        "device_anomaly_score",
        "late_hour_device_use + 2 * missing_disconnects + distinct_pcs_used",
    ),
    "drv_6_logon_suspicion": (
        "logon_suspicion",
        "after_hours_logons + weekend_logons + 2 * logons_on_other_user_pcs",
    ),
    "drv_7_total_risk_score": (
        "total_risk_score",
        "risk_score_1 + risk_score_2 + risk_score_3 + risk_score_4 + risk_score_5",
    ),
}


def _derived(name: str, column: str, expression: str) -> None:
    @query(
        name,
        sql=s.sql(s.PROFILE_PARTS, f'SELECT "user", {s.r(expression, column)} FROM profile'),
    )
    def _(spark, folder):
        profile = user_profiles(spark, folder)
        return rounded(profiles.add_derived(profile, [column]).select("user", column))


@query(
    "drv_1_log_columns",
    sql=s.sql(
        s.PROFILE_PARTS,
        'SELECT "user", {} FROM profile'.format(
            ", ".join(s.r(f"ln(1 + {c})", f"{c}_log") for c in fixed.LOG1P_COLUMNS)
        ),
    ),
)
def log_columns(spark, folder):
    names = [f"{c}_log" for c in fixed.LOG1P_COLUMNS]
    return rounded(profiles.log1p_columns(user_profiles(spark, folder)).select("user", *names))


for _name, (_column, _expression) in _DERIVED_SQL.items():
    _derived(_name, _column, _expression)

_PUBLISHED = f"""published AS (
  SELECT "user", {s.minmax('(-anomaly_score)', 'profile')} * 100 AS risk_score FROM profile
)"""


@query(
    "drv_8_published_risk_score",
    sql=s.sql([*s.PROFILE_PARTS, _PUBLISHED], f'SELECT "user", {s.r("risk_score")} FROM published'),
)
def published_score(spark, folder):
    profile = _profiles(spark, folder).select("user", "anomaly_score")
    return rounded(profiles.published_risk_score(profile).select("user", "risk_score"))


@query(
    "drv_9_published_risk_level",
    sql=s.sql(
        [*s.PROFILE_PARTS, _PUBLISHED],
        """SELECT "user", CASE WHEN risk_score >= 75 THEN 'High' WHEN risk_score >= 45
        THEN 'Medium' ELSE 'Low' END AS risk_level FROM published""",
    ),
)
def published_level(spark, folder):
    profile = _profiles(spark, folder).select("user", "anomaly_score")
    scored = profiles.published_risk_score(profile)
    return profiles.published_risk_level(scored).select("user", "risk_level")


@query(
    "profile_risk_without_model",
    sql=s.sql(
        s.EXPLAINED_PARTS,
        f'SELECT "user", {s.r("base_risk_score")}, {s.r("final_risk_score")}, risk_tier,'
        " risk_indicators FROM explained",
    ),
)
def profile_risk(spark, folder):
    return rounded(
        flows.assess_profiles(user_profiles(spark, folder)).select(
            "user", "base_risk_score", "final_risk_score", "risk_tier", "risk_indicators"
        )
    )


# --- NaN from Parquet counts as missing ---------------------------------------------------

_HOLED = (
    *s.PROFILE_PARTS,
    """holed AS (SELECT "user", CASE WHEN CAST("user" AS BIGINT) % 5 <> 0 THEN weekend_logons END AS x,
    CASE WHEN CAST("user" AS BIGINT) % 5 <> 0 THEN logon_std_dev_hours END AS y FROM profile)""",
)


def _holed(spark, folder):
    """Two columns in which every fifth user has a stored NaN."""
    gap = "if(cast(`user` as bigint) % 5 = 0, double('NaN'), {})"
    table = user_profiles(spark, folder).selectExpr(
        "`user`", f"{gap.format('weekend_logons')} as x", f"{gap.format('logon_std_dev_hours')} as y"
    )
    path = tables.write_table(table, scratch_path(spark, "holed") + ".parquet")
    return tables.read_table(spark, path)


def _each(expression: str) -> str:
    """The expression for both columns, rounded like the Spark side."""
    parts = ", ".join(s.r(expression.replace("{}", c), f"{c}_out") for c in ("x", "y"))
    return s.sql(_HOLED, f'SELECT "user", {parts} FROM holed')


def _outputs(df):
    return rounded(df.selectExpr("`user`", "cast(x_out as double) as x_out", "cast(y_out as double) as y_out"))


_NEW = {"x_out": "x", "y_out": "y"}
_OF = "(SELECT {0}({{}}) FROM holed)"


@query(
    "agg_8_mean_and_std_with_nan",
    sql=s.sql(
        _HOLED,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS n, round(avg({c}), 6) AS mean,"
            f" round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) + 0.0 AS lo, round(max({c}), 6) AS hi"
            " FROM holed"
            for c in ("x", "y")
        ),
    ),
)
def mean_and_std_with_nan(spark, folder):
    return rounded(
        statistics.summary_table(_holed(spark, folder), ("x", "y"), ("n", "mean", "sd", "lo", "hi"))
    )


@query(
    "agg_9_quantiles_with_nan",
    sql=s.sql(
        _HOLED,
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS p,"
            f" round(quantile_cont({c}, {p}), 6) + 0.0 AS value FROM holed"
            for c in ("x", "y")
            for p in _QUANTILES
        ),
    ),
)
def quantiles_with_nan(spark, folder):
    return rounded(statistics.quantile_table(_holed(spark, folder), {c: _QUANTILES for c in ("x", "y")}))


@query(
    "nrm_1_zscores_with_nan",
    sql=_each(f"({{}} - {_OF.format('avg')}) / ({_OF.format('stddev_samp')} + 1e-9)"),
)
def zscores_with_nan(spark, folder):
    return _outputs(statistics.add_zscores(_holed(spark, folder), _NEW))


@query(
    "nrm_2_top_quantile_flags_with_nan",
    sql=_each("CAST(coalesce({} > (SELECT quantile_cont({}, 0.8) FROM holed), false) AS INTEGER)"),
)
def quantile_flags_with_nan(spark, folder):
    wanted = {o: (c, 0.8) for o, c in _NEW.items()}
    return _outputs(statistics.add_quantile_flags(_holed(spark, folder), wanted))


@query(
    "nrm_3_two_sigma_spike_with_nan",
    sql=_each(
        f"CAST(coalesce({{}} > {_OF.format('avg')} + 2 * {_OF.format('stddev_samp')}, false) AS INTEGER)"
    ),
)
def spikes_with_nan(spark, folder):
    return _outputs(statistics.add_spikes(_holed(spark, folder), _NEW))


@query("nrm_4_unit_range_with_nan", sql=_each(s.minmax("{}", "holed")))
def unit_range_with_nan(spark, folder):
    return _outputs(statistics.add_unit_range(_holed(spark, folder), _NEW))


_AT = "(SELECT quantile_cont({{}}, {0}) FROM holed)"


@query(
    "nrm_5_robust_scale_with_nan",
    sql=_each(
        f"({{}} - {_AT.format(0.5)}) / coalesce(nullif({_AT.format(0.75)} - {_AT.format(0.25)}, 0), 1)"
    ),
)
def robust_scale_with_nan(spark, folder):
    scaled = statistics.robust_scale(_holed(spark, folder), ("x", "y"))
    return _outputs(scaled.withColumnsRenamed({"x": "x_out", "y": "y_out"}))


@query(
    "nrm_6_standard_scale_with_nan",
    sql=_each(f"({{}} - {_OF.format('avg')}) / coalesce(nullif({_OF.format('stddev_pop')}, 0), 1)"),
)
def standard_scale_with_nan(spark, folder):
    holed = _holed(spark, folder)
    scaled = statistics.Scaler.fit(holed, ("x", "y")).transform(holed)
    return _outputs(scaled.withColumnsRenamed({"x": "x_out", "y": "y_out"}))


@query("nrm_7_impute_medians_with_nan", sql=_each(f"coalesce({{}}, {_AT.format(0.5)})"))
def impute_medians_with_nan(spark, folder):
    filled = statistics.impute_medians(_holed(spark, folder), ("x", "y"))
    return _outputs(filled.withColumnsRenamed({"x": "x_out", "y": "y_out"}))
