"""Logs and user profiles derived from an event stream.

The stream has ``user_id``, ``ts``, ``event_type``, ``value`` and a JSON number
``k`` in ``props``. Everything is a projection of it or aggregates per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import after_hours, external_recipient, late_night, own_ratio, weekend
from ..operators.counting import totals_per_key

_ACTIVITY = """case event_type
    when 'purchase' then if(user_id % 3 = 0, 'Copy', 'usb_copy')
    when 'error' then if(user_id % 3 = 0, 'Logon', 'malicious_url_click')
    when 'signup' then 'Failed Login'
    when 'view' then 'email'
    when 'click' then 'file_write'
end"""

_COMBINED = {
    "user": "cast(user_id as string)",
    "date": "ts",
    "to": "if(k % 10 != 9, concat('u', k, if(k % 3 = 0, '@Company.com', '@mail.example')), null)",
    "activity": _ACTIVITY,
    "file_name": "concat('f', k, element_at("
    "array('.pdf', '.txt', '.zip', '.exe', '.doc', '.jpg'), k % 6 + 1))",
    "device": "if(k % 25 != 24, element_at("
    "array('USB_stick', 'laptop', 'Desktop', 'mobile'), k % 4 + 1), null)",
    "risk_multiplier": "1 + k / if(user_id % 4 = 0, 50D, 200D)",
    "label": "cast(user_id % 20 = 0 as int)",
    "k": "k",
    "value": "value",
    "event_type": "event_type",
    "event_id": "event_id",
}


def combined_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event with all four kinds of columns, multiplier and label."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k").selectExpr(
        *[f"{e} as `{c}`" for c, e in _COMBINED.items()]
    )


def kind_logs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The same events as four separate logs."""
    log = combined_log(spark, folder)
    return {
        "email": log.select("user", "date", "to"),
        "logon": log.select("user", "date", "activity"),
        "file": log.select("user", "date", "file_name", "activity"),
        "device": log.select("user", "date", "device"),
    }


def _count(condition: str) -> str:
    return f"cast(count_if({condition}) as double)"


_OFF, _LATE, _WEEKEND = after_hours("date"), late_night("date"), weekend("date")
_COPY = "event_type = 'purchase'"

_TOTALS = {
    "label": "max(label)",
    "sent": "count(to)",
    "external": f"count_if(to is not null and {external_recipient('to')})",
    "attachment_count_avg": "avg(k % 5)",
    "emails_sent_off_hours": _count(f"{_OFF} and k % 2 = 0"),
    "bcc_usage_rate": "avg(if(k % 7 = 0, 1, 0))",
    "total_files_copied": _count(_COPY),
    "off_copies": f"count_if({_COPY} and {_OFF})",
    **{
        f"filetype_{t}": _count(f"{_COPY} and endswith(file_name, '.{t}')")
        for t in ("doc", "exe", "jpg", "pdf", "txt", "zip")
    },
    "after_hours_logons": _count(f"event_type = 'signup' and {_OFF}"),
    "weekend_logons": _count(f"event_type = 'signup' and {_WEEKEND}"),
    "logons_on_other_user_pcs": _count("k >= 98"),
    "logon_std_dev_hours": "stddev_samp(hour(date))",
    "late_hour_device_use": _count(f"{_LATE} and k % 4 = 0"),
    "total_malicious_urls": _count("event_type = 'error' and k >= 95"),
    "off_clicks": f"count_if(event_type = 'click' and {_OFF})",
    # Distinct values of small domains, as the bits of one number.
    "domains": "bit_count(bit_or(if(event_type = 'click', shiftleft(1, k % 29), 0)))",
    "pcs": "bit_count(bit_or(if(k < 4, shiftleft(1, k), 0)))",
    "missing_disconnects": "count_if(k % 17 = 3)",
    "never_used_device": "max(if(k >= 99, 1L, 0L))",
    "connections": "count(device)",
    "above_avg_daily_counter": _count("value > 50"),
    **{f"risk_score_{i}": f"avg(if(k % 10 = {i}, 1, 0))" for i in range(1, 6)},
    "anomaly_score": "-avg(value)",
    "iforest_score": "-max(value)",
}

_DISTINCT = {"active_days": "to_date(date)", "unique_recipients_count": "`to`"}

_GAP = "cast(`user` as bigint) % 7 = 0"

_PROFILE = {
    "emails_sent_per_day": "sent / active_days",
    "active_days": "cast(active_days as double)",
    "unique_recipients_count": "cast(unique_recipients_count as double)",
    "external_emails_ratio": own_ratio("external", "sent"),
    "attachment_count_avg": f"if({_GAP}, null, attachment_count_avg)",
    "bcc_usage_rate": f"if({_GAP}, null, bcc_usage_rate)",
    "avg_files_copied_per_day": "total_files_copied / active_days",
    "after_hours_file_copy_ratio": own_ratio("off_copies", "total_files_copied"),
    "avg_malicious_urls_per_day": "total_malicious_urls / active_days",
    "avg_distinct_domains_per_day": "domains / active_days",
    "avg_after_hours_browsing_per_day": "off_clicks / active_days",
    "distinct_pcs_used": "cast(pcs as double)",
    "avg_daily_device_connections": "connections / active_days",
}


def user_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """One profile row per user.

    Some users have gaps in two columns. ``anomaly_score`` and ``iforest_score``
    are stand-ins for model output that are plain aggregates.
    """
    totals = totals_per_key(combined_log(spark, folder), "user", _TOTALS, _DISTINCT)
    helpers = {"sent", "external", "off_copies", "off_clicks", "domains", "pcs", "connections"}
    kept = [c for c in _TOTALS if c not in helpers and c not in _PROFILE]
    return totals.selectExpr("`user`", *kept, *[f"{e} as {c}" for c, e in _PROFILE.items()])
