"""AGG-1..7, JON-1..4 and NRM-3 over event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import fixed
from driftwarden.operators import logs, statistics
from driftwarden.session import materialize
from driftwarden.sources.events import combined_log, kind_logs

from . import sql as s
from .registry import query, rounded


def _kind(number: int, kind: str, columns: tuple[str, ...]) -> None:
    @query(
        f"agg_{number}_{kind}_features",
        sql=s.sql(s.LOG_PARTS, f'SELECT "user", {s.features(columns)} FROM features'),
    )
    def _(spark, folder):
        return rounded(logs.kind_features(kind_logs(spark, folder)[kind], kind))


_kind(1, "email", s.EMAIL)
_kind(2, "logon", s.LOGON)
_kind(3, "file", s.FILE)
_kind(4, "device", s.DEVICE)


@query(
    "agg_5_max_multiplier",
    sql=s.sql(
        [s.LOG],
        'SELECT "user", round(max(risk_multiplier), 6) + 0.0 AS risk_multiplier'
        ' FROM log GROUP BY "user"',
    ),
)
def max_multiplier(spark, folder):
    return rounded(logs.max_multiplier(combined_log(spark, folder)))


_FIRST = 'arg_min(activity, (epoch_us("date"), activity))'


@query(
    "agg_6_first_critical_activity",
    sql=s.sql(
        [s.LOG],
        f'SELECT "user", {_FIRST} AS activity FROM log WHERE {s.CRITICAL} GROUP BY "user"',
    ),
)
def first_critical(spark, folder):
    return logs.first_activity(combined_log(spark, folder), fixed.CRITICAL_ACTIVITIES)


@query(
    "agg_7_first_activity",
    sql=s.sql([s.LOG], f'SELECT "user", {_FIRST} AS activity FROM log GROUP BY "user"'),
)
def first_activity(spark, folder):
    return logs.first_activity(combined_log(spark, folder))


@query(
    "jon_1_merge_features",
    sql=s.sql(s.LOG_PARTS, f'SELECT "user", {s.features(s.ALL36)} FROM features'),
)
def merge_features(spark, folder):
    built = [logs.kind_features(l, k) for k, l in kind_logs(spark, folder).items()]
    return rounded(logs.merge_features(built).select("user", *fixed.LOG_FEATURES))


# Logs that do not know every user: copies only, failures only.
_PARTIAL = f"""partial_file AS (
  SELECT "user", count(*) AS file_access_count,
    CAST(count(*) > (SELECT avg(c) + 2 * stddev_samp(c) FROM (
      SELECT count(*) AS c FROM log WHERE activity = 'Copy' GROUP BY "user")) AS INTEGER)
      AS file_spike
  FROM log WHERE activity = 'Copy' GROUP BY "user"
), partial_logon AS (
  SELECT "user", count(*) AS login_count, {s.n(s.FAILED)} AS failed_logins
  FROM log WHERE activity = 'malicious_url_click' OR activity = 'Failed Login' GROUP BY "user"
)"""


@query(
    "jon_1_users_absent_from_some_logs",
    sql=s.sql(
        [s.LOG, _PARTIAL],
        """SELECT "user", coalesce(file_access_count, 0) AS file_access_count,
          coalesce(file_spike, 0) AS file_spike, coalesce(login_count, 0) AS login_count,
          coalesce(failed_logins, 0) AS failed_logins, 0 AS email_count
        FROM partial_file FULL JOIN partial_logon USING ("user")""",
    ),
)
def absent_users(spark, folder):
    by_kind = kind_logs(spark, folder)
    features = logs.log_features(
        {
            "file": by_kind["file"].where("activity = 'Copy'"),
            "logon": by_kind["logon"].where("activity in ('malicious_url_click', 'Failed Login')"),
        }
    )
    return features.select(
        "user", "file_access_count", "file_spike", "login_count", "failed_logins", "email_count"
    )


_SIGNALS = (*s.LOG_PARTS, s.SIGNALS)


@query(
    "jon_2_join_multiplier",
    sql=s.sql(
        _SIGNALS,
        'SELECT "user", email_count, round(risk_multiplier, 6) + 0.0 AS risk_multiplier'
        ' FROM features LEFT JOIN signals USING ("user")',
    ),
)
def join_multiplier(spark, folder):
    log = combined_log(spark, folder)
    features = logs.log_features(log).select("user", "email_count")
    return rounded(logs.join_left(features, logs.max_multiplier(log)))


@query(
    "jon_3_join_with_suffix",
    sql=s.sql(
        [s.LOG],
        f"""SELECT "user", a.activity, c.activity AS activity_crit
        FROM (SELECT "user", {_FIRST} AS activity FROM log GROUP BY "user") a
        LEFT JOIN (SELECT "user", {_FIRST} AS activity FROM log WHERE {s.CRITICAL}
                   GROUP BY "user") c USING ("user")""",
    ),
)
def join_with_suffix(spark, folder):
    log = combined_log(spark, folder)
    critical = logs.first_activity(log, fixed.CRITICAL_ACTIVITIES)
    return logs.join_left(logs.first_activity(log), critical, suffix="_crit")


@query("jon_4_fill_from_lookup", sql=s.sql(_SIGNALS, 'SELECT "user", activity FROM signals'))
def fill_from_lookup(spark, folder):
    log = combined_log(spark, folder)
    everyone = log.select("user").distinct()
    critical = logs.first_activity(log, fixed.CRITICAL_ACTIVITIES)
    return logs.fill_from(
        logs.join_left(everyone, critical), logs.first_activity(log), "activity"
    )


@query(
    "nrm_3_two_sigma_spike",
    sql=s.sql(
        s.LOG_PARTS, 'SELECT "user", login_count, login_spike, email_spike FROM features'
    ),
)
def two_sigma(spark, folder):
    counts = materialize(
        combined_log(spark, folder)
        .groupBy("user")
        .agg(F.count("date").alias("login_count"), F.count("to").alias("email_count"))
    )
    spikes = {"login_spike": "login_count", "email_spike": "email_count"}
    return statistics.add_spikes(counts, spikes).drop("email_count")


@query(
    "scr_12_forward_signals",
    sql=s.sql(
        _SIGNALS,
        'SELECT "user", login_count, activity, round(risk_multiplier, 6) + 0.0 AS risk_multiplier'
        ' FROM features LEFT JOIN signals USING ("user")',
    ),
)
def forward_signals(spark, folder):
    log = combined_log(spark, folder)
    features = logs.log_features(log).select("user", "login_count")
    return rounded(logs.forward_signals(features, log))


@query(
    "scr_12_signals_of_separate_logs",
    sql=s.sql(
        _SIGNALS,
        'SELECT "user", login_count, activity, round(risk_multiplier, 6) + 0.0 AS risk_multiplier'
        ' FROM features LEFT JOIN signals USING ("user")',
    ),
)
def signals_of_separate_logs(spark, folder):
    """Equal to the signals of one combined log: activities and multipliers are gathered
    from whichever log has them."""
    log = combined_log(spark, folder)
    parts = kind_logs(spark, folder) | {"device": log.select("user", "date", "device", "risk_multiplier")}
    features = logs.log_features(parts).select("user", "login_count")
    return rounded(logs.forward_signals(features, logs.signal_events(list(parts.values()))))
