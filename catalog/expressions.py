"""EXP-1..29: row expressions over the whole log or profile table."""

from __future__ import annotations

from driftwarden import functions as fn
from driftwarden.sources.events import combined_log, user_profiles

from . import sql as s
from .registry import query, rounded


def _over_log(name: str, expression: str, sql_expression: str, output: str) -> None:
    """One expression per event."""

    @query(name, sql=s.sql([s.LOG], f"SELECT event_id, {sql_expression} AS {output} FROM log"))
    def _(spark, folder):
        return rounded(combined_log(spark, folder).selectExpr("event_id", f"{expression} as {output}"))


def _over_profiles(name: str, expression: str, sql_expression: str, output: str) -> None:
    """One expression per user."""

    @query(
        name,
        sql=s.sql(s.PROFILE_PARTS, f'SELECT "user", {sql_expression} AS {output} FROM profile'),
    )
    def _(spark, folder):
        return rounded(user_profiles(spark, folder).selectExpr("`user`", f"{expression} as {output}"))


_over_log(
    "exp_1_parse_timestamp",
    f"unix_micros(cast({fn.parse_date('cast(date as string)')} as timestamp))",
    'epoch_us("date")',
    "micros",
)
_over_log("exp_2_hour", fn.event_hour("date"), "CAST(h AS INTEGER)", "event_hour")
_over_log("exp_3_weekday", fn.event_weekday("date"), "CAST(wd AS INTEGER)", "event_weekday")
_over_log("exp_4_late_night", fn.late_night("date"), s.LATE, "late_night")
_over_log("exp_5_after_hours", fn.after_hours("date"), s.OFF, "after_hours")
_over_log("exp_6_weekend", fn.weekend("date"), s.WEEKEND, "weekend")
_over_log("exp_7_external_recipient", fn.external_recipient("`to`"), s.EXTERNAL, "external")
_over_log("exp_8_failed_login", fn.contains_word("activity", "fail"), s.FAILED, "failed")
_over_log("exp_9_file_copy", fn.contains_word("activity", "copy"), s.COPIED, "copied")
_over_log("exp_10_sensitive_file", fn.sensitive_file("file_name"), s.SENSITIVE, "sensitive")
_over_log("exp_11_usb", fn.contains_word("device", "usb"), s.USB, "usb")
_over_log("exp_12_unknown_device", fn.unknown_device("device"), s.UNKNOWN, "unknown")
_over_log("exp_13_critical_activity", fn.critical_activity("activity"), s.CRITICAL, "critical")
_over_profiles(
    "exp_14_null_to_default",
    fn.or_default("bcc_usage_rate"),
    "round(coalesce(bcc_usage_rate, 0), 6) + 0.0",
    "bcc_filled",
)
_over_profiles(
    "exp_15_clip",
    fn.clip("avg_distinct_domains_per_day - 0.3", 0.0, 0.1),
    "round(greatest(0, least(0.1, avg_distinct_domains_per_day - 0.3)), 6) + 0.0",
    "clipped",
)
_over_profiles(
    "exp_16_safe_ratio",
    fn.safe_ratio("emails_sent_off_hours", "emails_sent_per_day"),
    "round(emails_sent_off_hours / (emails_sent_per_day + 1), 6) + 0.0",
    "safe_ratio",
)
_over_profiles(
    "exp_17_own_ratio",
    fn.own_ratio("total_malicious_urls", "logons_on_other_user_pcs"),
    "round(coalesce(total_malicious_urls / nullif(logons_on_other_user_pcs, 0), 0), 6) + 0.0",
    "own_ratio",
)
_over_profiles(
    "exp_18_flag",
    fn.as_flag("bcc_usage_rate > 0.15"),
    "CAST(coalesce(bcc_usage_rate > 0.15, false) AS INTEGER)",
    "flag",
)
_over_profiles(
    "exp_19_whole_number",
    fn.as_whole("anomaly_score"),
    "CAST(trunc(anomaly_score) AS INTEGER)",
    "whole",
)
_over_profiles(
    "exp_20_two_way",
    fn.either("total_malicious_urls > 0", "-1", "1"),
    "CASE WHEN total_malicious_urls > 0 THEN -1 ELSE 1 END",
    "two_way",
)
_over_profiles(
    "exp_21_multi_way",
    fn.by_cuts("above_avg_daily_counter", (("High", 25.0), ("Medium", 20.0)), "Low"),
    "CASE WHEN above_avg_daily_counter >= 25 THEN 'High'"
    " WHEN above_avg_daily_counter >= 20 THEN 'Medium' ELSE 'Low' END",
    "multi_way",
)
_over_profiles(
    "exp_22_raise_to_floor",
    fn.floor_where("label = 1", "above_avg_daily_counter", 25.0),
    "CASE WHEN label = 1 THEN greatest(above_avg_daily_counter, 25)"
    " ELSE above_avg_daily_counter END",
    "raised",
)
_over_profiles(
    "exp_23_round",
    fn.round_half_even("anomaly_score", 2),
    "round_even(anomaly_score, 2)",
    "rounded_score",
)
_over_log(
    "exp_24_lower_strip",
    fn.tidy("concat('  ', device, ' ')"),
    "lower(trim('  ' || device || ' '))",
    "tidied",
)
_over_log(
    "exp_25_shorten",
    fn.shorten("concat_ws(' | ', activity, file_name, device, `to`, `user`)"),
    "substring(concat_ws(' | ', activity, file_name, device, \"to\", \"user\"), 1, 45)",
    "shortened",
)
_over_log(
    "exp_26_join_texts",
    fn.join_texts(
        [
            (fn.late_night("date"), "late"),
            (fn.weekend("date"), "weekend"),
            (fn.external_recipient("`to`"), "external"),
        ],
        "nothing",
    ),
    f"coalesce(nullif(concat_ws(' | ', CASE WHEN {s.LATE} THEN 'late' END,"
    f" CASE WHEN {s.WEEKEND} THEN 'weekend' END,"
    f" CASE WHEN {s.EXTERNAL} THEN 'external' END), ''), 'nothing')",
    "texts",
)
_over_profiles(
    "exp_27_weighted_sum",
    fn.weighted_sum([(0.35, "risk_score_1"), (0.25, "risk_score_2"), (0.4, "risk_score_3")]),
    "round(0.35 * risk_score_1 + 0.25 * risk_score_2 + 0.4 * risk_score_3, 6) + 0.0",
    "weighted",
)
_over_profiles(
    "exp_28_product",
    fn.product_of(["external_emails_ratio", "after_hours_file_copy_ratio"]),
    "round(external_emails_ratio * after_hours_file_copy_ratio, 6) + 0.0",
    "product",
)
_over_profiles("exp_29_constant", fn.number(1), "1", "constant")
