"""The same tables in SQL: common table expressions that queries build on.

Names, words, cuts, weights and texts in these expressions are fixed values: results depend
on them. They are written out here, apart from ``driftwarden.fixed``, so that a wrong one
in either place shows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

LOG = """log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS "user", ts AS "date",
    CASE WHEN k % 10 <> 9 THEN 'u' || k ||
      CASE WHEN k % 3 = 0 THEN '@Company.com' ELSE '@mail.example' END END AS "to",
    CASE event_type
      WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'Copy' ELSE 'usb_copy' END
      WHEN 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'Logon' ELSE 'malicious_url_click' END
      WHEN 'signup' THEN 'Failed Login'
      WHEN 'view' THEN 'email'
      WHEN 'click' THEN 'file_write' END AS activity,
    'f' || k || CASE k % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.txt' WHEN 2 THEN '.zip'
      WHEN 3 THEN '.exe' WHEN 4 THEN '.doc' ELSE '.jpg' END AS file_name,
    CASE WHEN k % 25 <> 24 THEN CASE k % 4 WHEN 0 THEN 'USB_stick' WHEN 1 THEN 'laptop'
      WHEN 2 THEN 'Desktop' ELSE 'mobile' END END AS device,
    1 + k / CAST(CASE WHEN user_id % 4 = 0 THEN 50 ELSE 200 END AS DOUBLE) AS risk_multiplier,
    CAST(user_id % 20 = 0 AS INTEGER) AS label, k, value, event_type,
    hour(ts) AS h, isodow(ts) - 1 AS wd
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
)"""

LATE = "(h >= 22 OR h <= 5)"
OFF = "(h < 8 OR h > 18)"
WEEKEND = "(wd >= 5)"
EXTERNAL = "NOT coalesce(regexp_matches(\"to\", '(?i)@company.com'), false)"
FAILED = "(activity IS NOT NULL AND lower(activity) LIKE '%fail%')"
COPIED = "(activity IS NOT NULL AND lower(activity) LIKE '%copy%')"
SENSITIVE = r"regexp_matches(lower(file_name), '\.(pdf|doc|docx|xls|xlsx|csv|zip)$')"
USB = "coalesce(lower(device) LIKE '%usb%', false)"
UNKNOWN = (
    "NOT coalesce(lower(device) IN ('laptop', 'desktop', 'workstation', 'company_pc'), false)"
)
CRITICAL = "coalesce(lower(activity) IN ('usb_copy', 'file_download', 'malicious_url_click'), false)"

EMAIL = (
    "email_count", "recipient_count", "external_count", "late_night_count", "weekend_count",
    "external_ratio", "late_night_ratio", "weekend_ratio", "email_spike",
)
LOGON = (
    "login_count", "late_logins", "weekend_logins", "after_hours_logins", "failed_logins",
    "late_login_ratio", "weekend_login_ratio", "after_hours_ratio", "login_spike",
)
FILE = (
    "file_access_count", "file_copy_count", "sensitive_file_access", "after_hours_file_access",
    "weekend_file_access", "copy_ratio", "sensitive_ratio", "after_hours_file_ratio", "file_spike",
)
DEVICE = (
    "device_activity_count", "usb_insertions", "unknown_device_count", "after_hours_device_usage",
    "weekend_device_usage", "usb_ratio", "unknown_device_ratio", "after_hours_device_ratio",
    "device_spike",
)
ALL36 = EMAIL + LOGON + FILE + DEVICE


def n(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


COUNTS = f"""counts AS (
  SELECT "user", count("to") AS email_count, count(DISTINCT "to") AS recipient_count,
    {n(EXTERNAL)} AS external_count, {n(LATE)} AS late_night_count, {n(WEEKEND)} AS weekend_count,
    count("date") AS login_count, {n(LATE)} AS late_logins, {n(WEEKEND)} AS weekend_logins,
    {n(OFF)} AS after_hours_logins, {n(FAILED)} AS failed_logins,
    count(file_name) AS file_access_count, {n(COPIED)} AS file_copy_count,
    {n(SENSITIVE)} AS sensitive_file_access, {n(OFF)} AS after_hours_file_access,
    {n(WEEKEND)} AS weekend_file_access,
    count(device) AS device_activity_count, {n(USB)} AS usb_insertions,
    {n(UNKNOWN)} AS unknown_device_count, {n(OFF)} AS after_hours_device_usage,
    {n(WEEKEND)} AS weekend_device_usage
  FROM log WHERE "user" IS NOT NULL GROUP BY "user"
)"""


def _ratio(part: str, whole: str) -> str:
    return f"coalesce({part} / nullif(CAST({whole} AS DOUBLE), 0), 0)"


def _spike(column: str) -> str:
    cut = f"(SELECT avg({column}) + 2 * stddev_samp({column}) FROM counts)"
    return f"CAST(coalesce({column} > {cut}, false) AS INTEGER)"


FEATURES = f"""features AS (
  SELECT *,
    {_ratio('external_count', 'email_count')} AS external_ratio,
    {_ratio('late_night_count', 'email_count')} AS late_night_ratio,
    {_ratio('weekend_count', 'email_count')} AS weekend_ratio,
    {_spike('email_count')} AS email_spike,
    {_ratio('late_logins', 'login_count')} AS late_login_ratio,
    {_ratio('weekend_logins', 'login_count')} AS weekend_login_ratio,
    {_ratio('after_hours_logins', 'login_count')} AS after_hours_ratio,
    {_spike('login_count')} AS login_spike,
    {_ratio('file_copy_count', 'file_access_count')} AS copy_ratio,
    {_ratio('sensitive_file_access', 'file_access_count')} AS sensitive_ratio,
    {_ratio('after_hours_file_access', 'file_access_count')} AS after_hours_file_ratio,
    {_spike('file_access_count')} AS file_spike,
    {_ratio('usb_insertions', 'device_activity_count')} AS usb_ratio,
    {_ratio('unknown_device_count', 'device_activity_count')} AS unknown_device_ratio,
    {_ratio('after_hours_device_usage', 'device_activity_count')} AS after_hours_device_ratio,
    {_spike('device_activity_count')} AS device_spike
  FROM counts
)"""

SIGNALS = f"""signals AS (
  SELECT "user", max(risk_multiplier) AS risk_multiplier,
    coalesce(arg_min(activity, (epoch_us("date"), activity)) FILTER (WHERE {CRITICAL}),
             arg_min(activity, (epoch_us("date"), activity))) AS activity
  FROM log WHERE activity IS NOT NULL GROUP BY "user"
)"""


def _copies(extension: str) -> str:
    return n(f"event_type = 'purchase' AND file_name LIKE '%.{extension}'")


PROFILE = f"""totals AS (
  SELECT "user", max(label) AS label,
    CAST(count(DISTINCT CAST("date" AS DATE)) AS DOUBLE) AS active_days,
    CAST(count(DISTINCT "to") AS DOUBLE) AS unique_recipients_count,
    count("to") AS sent, {n('"to" IS NOT NULL AND ' + EXTERNAL)} AS external,
    avg(k % 5) AS attachment_count_avg,
    CAST({n(OFF + ' AND k % 2 = 0')} AS DOUBLE) AS emails_sent_off_hours,
    avg(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) AS bcc_usage_rate,
    CAST({n("event_type = 'purchase'")} AS DOUBLE) AS total_files_copied,
    {n("event_type = 'purchase' AND " + OFF)} AS off_copies,
    {', '.join(f'CAST({_copies(t)} AS DOUBLE) AS filetype_{t}'
               for t in ('doc', 'exe', 'jpg', 'pdf', 'txt', 'zip'))},
    CAST({n("event_type = 'signup' AND " + OFF)} AS DOUBLE) AS after_hours_logons,
    CAST({n("event_type = 'signup' AND " + WEEKEND)} AS DOUBLE) AS weekend_logons,
    CAST({n('k >= 98')} AS DOUBLE) AS logons_on_other_user_pcs,
    stddev_samp(h) AS logon_std_dev_hours,
    CAST({n(LATE + ' AND k % 4 = 0')} AS DOUBLE) AS late_hour_device_use,
    CAST({n("event_type = 'error' AND k >= 95")} AS DOUBLE) AS total_malicious_urls,
    {n("event_type = 'click' AND " + OFF)} AS off_clicks,
    count(DISTINCT CASE WHEN event_type = 'click' THEN k % 29 END) AS domains,
    count(DISTINCT CASE WHEN k < 4 THEN k END) AS pcs,
    {n('k % 17 = 3')} AS missing_disconnects,
    CAST(max(CASE WHEN k >= 99 THEN 1 ELSE 0 END) AS BIGINT) AS never_used_device,
    count(device) AS connections,
    CAST({n('value > 50')} AS DOUBLE) AS above_avg_daily_counter,
    {', '.join(f'avg(CASE WHEN k % 10 = {i} THEN 1 ELSE 0 END) AS risk_score_{i}'
               for i in range(1, 6))},
    -avg(value) AS anomaly_score, -max(value) AS iforest_score
  FROM log GROUP BY "user"
), profile AS (
  SELECT * EXCLUDE (sent, external, off_copies, off_clicks, domains, pcs, connections)
    REPLACE (CASE WHEN CAST("user" AS BIGINT) % 7 <> 0 THEN attachment_count_avg END
               AS attachment_count_avg,
             CASE WHEN CAST("user" AS BIGINT) % 7 <> 0 THEN bcc_usage_rate END AS bcc_usage_rate),
    sent / active_days AS emails_sent_per_day,
    coalesce(external / nullif(CAST(sent AS DOUBLE), 0), 0) AS external_emails_ratio,
    total_files_copied / active_days AS avg_files_copied_per_day,
    coalesce(off_copies / nullif(total_files_copied, 0), 0) AS after_hours_file_copy_ratio,
    total_malicious_urls / active_days AS avg_malicious_urls_per_day,
    domains / active_days AS avg_distinct_domains_per_day,
    off_clicks / active_days AS avg_after_hours_browsing_per_day,
    CAST(pcs AS DOUBLE) AS distinct_pcs_used,
    connections / active_days AS avg_daily_device_connections
  FROM totals
)"""

PROFILE_COLUMNS = (
    "active_days", "unique_recipients_count", "attachment_count_avg", "emails_sent_off_hours",
    "bcc_usage_rate", "total_files_copied", "filetype_doc", "filetype_exe", "filetype_jpg",
    "filetype_pdf", "filetype_txt", "filetype_zip", "after_hours_logons", "weekend_logons",
    "logons_on_other_user_pcs", "logon_std_dev_hours", "late_hour_device_use",
    "total_malicious_urls", "missing_disconnects", "never_used_device",
    "above_avg_daily_counter", "emails_sent_per_day", "external_emails_ratio",
    "avg_files_copied_per_day", "after_hours_file_copy_ratio", "avg_malicious_urls_per_day",
    "avg_distinct_domains_per_day", "avg_after_hours_browsing_per_day", "distinct_pcs_used",
    "avg_daily_device_connections",
)

Z = {
    "ext_email_ratio_zscore": "external_emails_ratio",
    "recipient_spread_zscore": "unique_recipients_count",
    "files_copy_volume_zscore": "total_files_copied",
    "after_hours_logon_zscore": "after_hours_logons",
    "malicious_url_zscore": "avg_malicious_urls_per_day",
    "domain_spread_zscore": "avg_distinct_domains_per_day",
    "missing_disc_zscore": "missing_disconnects",
    "device_conn_zscore": "avg_daily_device_connections",
}


def _z(name: str) -> str:
    x = f"coalesce({Z[name]}, 0)"
    return (
        f"({x} - (SELECT avg({x}) FROM profile))"
        f" / ((SELECT stddev_samp({x}) FROM profile) + 1e-9) AS {name}"
    )


def _q(column: str, p: float, name: str, filled: bool = True) -> str:
    x = f"coalesce({column}, 0)" if filled else column
    cut = f"(SELECT quantile_cont({x}, {p}) FROM profile)"
    return f"CAST(coalesce({x} > {cut}, false) AS INTEGER) AS {name}"


PILLARS = f"""first_layer AS (
  SELECT "user", label, iforest_score,
    external_emails_ratio AS ext_email_ratio, {_z('ext_email_ratio_zscore')},
    emails_sent_off_hours AS off_hours_email_count,
    emails_sent_off_hours / (emails_sent_per_day * active_days + 1) AS off_hours_email_ratio,
    {_q('bcc_usage_rate', 0.9, 'bcc_abuse_flag', filled=False)},
    coalesce(bcc_usage_rate, 0) AS bcc_usage_rate,
    coalesce(attachment_count_avg, 0) AS attachment_density,
    {_q('attachment_count_avg', 0.9, 'high_attachment_flag')},
    unique_recipients_count AS unique_recipient_count, {_z('recipient_spread_zscore')},
    total_files_copied, avg_files_copied_per_day AS avg_files_per_day,
    {_z('files_copy_volume_zscore')}, after_hours_file_copy_ratio AS after_hours_file_ratio,
    {_q('after_hours_file_copy_ratio', 0.85, 'after_hours_file_spike')},
    filetype_exe / (total_files_copied + 1) AS exe_file_ratio,
    filetype_zip / (total_files_copied + 1) AS zip_file_ratio,
    least(1, (filetype_exe + filetype_zip) / (total_files_copied + 1)) AS risky_filetype_score,
    least(1, (filetype_pdf + filetype_doc) / (total_files_copied + 1)) AS sensitive_doc_ratio,
    after_hours_logons AS after_hours_logon_count, {_z('after_hours_logon_zscore')},
    weekend_logons AS weekend_logon_count, {_q('weekend_logons', 0.8, 'weekend_logon_flag')},
    logons_on_other_user_pcs AS other_pc_logon_count,
    CAST(logons_on_other_user_pcs > 0 AS INTEGER) AS other_pc_logon_flag,
    coalesce(logon_std_dev_hours, 0) AS logon_time_std,
    {_q('logon_std_dev_hours', 0.85, 'logon_erratic_flag')},
    late_hour_device_use, CAST(0 AS DOUBLE) AS off_hours_intensity,
    avg_malicious_urls_per_day AS malicious_url_avg, total_malicious_urls AS malicious_url_total,
    CAST(total_malicious_urls > 0 AS INTEGER) AS malicious_url_flag, {_z('malicious_url_zscore')},
    avg_distinct_domains_per_day AS distinct_domain_avg, {_z('domain_spread_zscore')},
    avg_after_hours_browsing_per_day AS after_hours_browsing_avg,
    {_q('avg_after_hours_browsing_per_day', 0.8, 'after_hours_browse_flag')},
    distinct_pcs_used, CAST(distinct_pcs_used > 1 AS INTEGER) AS multi_pc_flag,
    CAST(missing_disconnects AS DOUBLE) AS missing_disconnects, {_z('missing_disc_zscore')},
    CAST(never_used_device > 0 AS INTEGER) AS never_used_device_flag,
    avg_daily_device_connections AS avg_device_connections, {_z('device_conn_zscore')}
  FROM profile
), second_layer AS (
  SELECT *,
    least(1, 0.35 * greatest(0, least(5, ext_email_ratio_zscore)) / 5
      + 0.25 * greatest(0, least(1, off_hours_email_ratio))
      + 0.20 * greatest(0, least(1, bcc_usage_rate)) + 0.10 * high_attachment_flag
      + 0.10 * greatest(0, least(5, recipient_spread_zscore)) / 5) AS email_exfil_composite,
    least(1, 0.30 * greatest(0, least(5, files_copy_volume_zscore)) / 5
      + 0.30 * greatest(0, least(1, after_hours_file_ratio)) + 0.25 * risky_filetype_score
      + 0.15 * sensitive_doc_ratio) AS file_staging_composite,
    least(1, 0.30 * greatest(0, least(5, after_hours_logon_zscore)) / 5 + 0.20 * weekend_logon_flag
      + 0.25 * other_pc_logon_flag + 0.15 * logon_erratic_flag
      + 0.10 * greatest(0, least(1, late_hour_device_use))) AS temporal_anomaly_composite,
    least(1, 0.40 * greatest(0, least(5, malicious_url_zscore)) / 5 + 0.20 * malicious_url_flag
      + 0.25 * greatest(0, least(5, domain_spread_zscore)) / 5
      + 0.15 * after_hours_browse_flag) AS network_anomaly_composite,
    least(1, 0.25 * multi_pc_flag + 0.25 * greatest(0, least(5, missing_disc_zscore)) / 5
      + 0.25 * never_used_device_flag
      + 0.25 * greatest(0, least(5, device_conn_zscore)) / 5) AS device_anomaly_composite
  FROM first_layer
), pillars AS (
  SELECT *,
    email_exfil_composite * file_staging_composite AS email_file_exfil_chain,
    off_hours_email_ratio * temporal_anomaly_composite AS dual_off_hours_signal,
    malicious_url_flag * risky_filetype_score AS network_file_chain,
    multi_pc_flag * other_pc_logon_flag AS lateral_movement_score,
    least(1, 0.30 * email_exfil_composite + 0.25 * file_staging_composite
      + 0.20 * temporal_anomaly_composite + 0.15 * network_anomaly_composite
      + 0.10 * device_anomaly_composite) AS exfil_chain_score
  FROM second_layer
)"""

ROBUST = (
    "ext_email_ratio_zscore", "recipient_spread_zscore", "email_exfil_composite",
    "files_copy_volume_zscore", "risky_filetype_score", "file_staging_composite",
    "after_hours_logon_zscore", "temporal_anomaly_composite", "malicious_url_zscore",
    "domain_spread_zscore", "network_anomaly_composite", "missing_disc_zscore",
    "device_conn_zscore", "device_anomaly_composite", "lateral_movement_score",
    "exfil_chain_score",
)


def _robust(x: str) -> str:
    q = f"(SELECT quantile_cont({x}, {{}}) FROM pillars)"
    low, middle, high = (q.format(p) for p in (0.25, 0.5, 0.75))
    spread = f"(CASE WHEN {high} = {low} THEN 1 ELSE {high} - {low} END)"
    return f"({x} - {middle}) / {spread} AS {x}"


SCALED = f"""scaled AS (
  SELECT * REPLACE ({', '.join(map(_robust, ROBUST))}) FROM pillars
)"""

WEIGHTS = {
    "critical": (
        ("malicious_url_flag", 10, "Any malicious URL access"),
        ("malicious_url_zscore", 8, "Malicious URL spike vs population"),
        ("after_hours_file_spike", 8, "After-hours file copy anomaly"),
        ("bcc_abuse_flag", 7, "BCC usage rate anomaly (data hiding)"),
        ("email_file_exfil_chain", 9, "Email + file exfiltration combo"),
        ("exfil_chain_score", 9, "Multi-pillar exfiltration chain"),
    ),
    "high": (
        ("ext_email_ratio_zscore", 6, "External email ratio spike"),
        ("off_hours_email_ratio", 6, "Off-hours email proportion"),
        ("risky_filetype_score", 5, "EXE + ZIP file copy ratio"),
        ("after_hours_file_ratio", 6, "After-hours file copy ratio"),
        ("other_pc_logon_flag", 5, "Logons on other users PCs"),
        ("lateral_movement_score", 5, "Multi-PC + other-user logon combo"),
        ("dual_off_hours_signal", 5, "Concurrent off-hours email + file"),
        ("network_file_chain", 5, "Malicious URL + risky file types"),
    ),
    "medium": (
        ("after_hours_logon_zscore", 3, ""), ("weekend_logon_flag", 3, ""),
        ("files_copy_volume_zscore", 3, ""), ("domain_spread_zscore", 3, ""),
        ("missing_disc_zscore", 2, ""), ("never_used_device_flag", 3, ""),
        ("high_attachment_flag", 2, ""), ("sensitive_doc_ratio", 2, ""),
        ("after_hours_browse_flag", 2, ""),
    ),
    "low": (
        ("attachment_density", 1, ""), ("multi_pc_flag", 1, ""), ("logon_erratic_flag", 1, ""),
        ("recipient_spread_zscore", 1, ""), ("device_conn_zscore", 0.5, ""),
    ),
}


def minmax(x: str, table: str) -> str:
    low, high = f"(SELECT min({x}) FROM {table})", f"(SELECT max({x}) FROM {table})"
    return f"(CASE WHEN {high} - {low} < 1e-9 THEN 0 ELSE ({x} - {low}) / ({high} - {low}) END)"


def _tier(tier: str) -> str:
    total = sum(w for _, w, _ in WEIGHTS[tier])
    parts = [
        f"{w} / CAST({total} AS DOUBLE) * {minmax(f'greatest({c}, 0)', 'scaled')}"
        for c, w, _ in WEIGHTS[tier]
    ]
    return f"least(1, greatest(0, {' + '.join(parts)})) AS score_tier_{tier}"


TIERS = f"""tiers AS (SELECT *, {', '.join(map(_tier, WEIGHTS))} FROM scaled)"""
TOTAL = """total AS (
  SELECT *, 2.5 * score_tier_critical + 1.5 * score_tier_high + 0.8 * score_tier_medium
    + 0.3 * score_tier_low AS raw_total FROM tiers
)"""
BASE = f"base AS (SELECT *, {minmax('raw_total', 'total')} * 100 AS base_risk_score FROM total)"
PLAIN_FINAL = """final AS (
  SELECT *, CAST(NULL AS DOUBLE) AS anomaly_model_score, base_risk_score AS final_risk_score
  FROM base
)"""
BLENDED_FINAL = f"""blended AS (
  SELECT *, {minmax('(-iforest_score)', 'base')} * 100 AS anomaly_model_score FROM base
), final AS (
  SELECT *, least(100, greatest(0, 0.7 * base_risk_score + 0.3 * anomaly_model_score))
    AS final_risk_score FROM blended
)"""
BUCKETS = """cuts AS (
  SELECT quantile_cont(final_risk_score, 0.7) AS medium_threshold,
    quantile_cont(final_risk_score, 0.9) AS high_threshold FROM final
), buckets AS (
  SELECT *, CASE WHEN final_risk_score >= high_threshold THEN 'High'
    WHEN final_risk_score >= medium_threshold THEN 'Medium' ELSE 'Low' END AS risk_tier
  FROM final CROSS JOIN cuts
)"""


def _indicator(tier: str, column: str, words: str) -> str:
    cut = f"(SELECT quantile_cont({column}, 0.75) FROM scaled)"
    return f"CASE WHEN {column} > 0 AND {column} >= {cut} THEN '[{tier.upper()}] {words}' END"


_SHOWN = ", ".join(
    _indicator(tier, column, words)
    for tier in ("critical", "high")
    for column, _, words in WEIGHTS[tier]
)
INDICATORS = f"""explained AS (
  SELECT *, coalesce(nullif(concat_ws(' | ', {_SHOWN}), ''), 'No significant indicators')
    AS risk_indicators FROM buckets
)"""

# Log flow: rule score on features with a deterministic stand-in for the model.
DECIDED = """decided AS (
  SELECT f.*, s.activity, s.risk_multiplier, p.iforest_score AS decision, p.label
  FROM features f LEFT JOIN signals s USING ("user") LEFT JOIN (
    SELECT "user", 0.25 * max(value) - avg(value) AS iforest_score, max(label) AS label
    FROM log GROUP BY "user") p USING ("user")
)"""
RULE = (
    "20 * external_ratio + 15 * late_night_ratio + 15 * after_hours_ratio"
    " + 10 * weekend_login_ratio + 15 * copy_ratio + 10 * sensitive_ratio + 10 * usb_ratio"
    " + 5 * unknown_device_ratio"
)
BOOST = (
    f"CASE WHEN {CRITICAL} THEN 45.0"
    " WHEN lower(activity) IN ('email', 'file_write') THEN 15.0 ELSE 0.0 END"
)
REASON = """coalesce(nullif(concat_ws(' | ',
    CASE WHEN external_ratio > 0.5 THEN 'High external email communication' END,
    CASE WHEN late_night_ratio > 0.3 THEN 'Frequent late-night activity' END,
    CASE WHEN weekend_login_ratio > 0.3 THEN 'Frequent weekend access' END,
    CASE WHEN copy_ratio > 0.5 THEN 'High file copy activity' END,
    CASE WHEN sensitive_ratio > 0.5 THEN 'Sensitive file access' END,
    CASE WHEN usb_ratio > 0.5 THEN 'Heavy USB device usage' END,
    CASE WHEN unknown_device_ratio > 0.3 THEN 'Unknown device detected' END), ''),
    'No major threat indicators detected')"""
LEVEL = (
    "CASE WHEN risk_score >= 70 THEN 'High' WHEN risk_score >= 40 THEN 'Medium' ELSE 'Low' END"
)
THREATS = f"""flagged AS (
  SELECT *, CAST(decision < 0 AS INTEGER) AS anomaly,
    round_even((1 - (decision - (SELECT min(decision) FROM decided))
      / ((SELECT max(decision) - min(decision) FROM decided) + 1e-8)) * 100, 2) AS anomaly_score,
    {RULE} + {BOOST} AS rule_score
  FROM decided
), floored AS (
  SELECT *, CASE WHEN anomaly = 1 THEN greatest(rule_score, 75) ELSE rule_score END AS with_floor
  FROM flagged
), scored AS (
  SELECT *, least(100, greatest(0, CASE WHEN risk_multiplier >= 2.0
    THEN greatest(with_floor, 85) ELSE with_floor END)) AS risk_score FROM floored
), threats AS (SELECT *, {LEVEL} AS risk_level, {REASON} AS reason FROM scored)"""

LOG_PARTS = (LOG, COUNTS, FEATURES)
THREAT_PARTS = (*LOG_PARTS, SIGNALS, DECIDED, THREATS)
PROFILE_PARTS = (LOG, PROFILE)
PILLAR_PARTS = (*PROFILE_PARTS, PILLARS)
SCALED_PARTS = (*PILLAR_PARTS, SCALED)
BASE_PARTS = (*SCALED_PARTS, TIERS, TOTAL, BASE)
BUCKET_PARTS = (*BASE_PARTS, PLAIN_FINAL, BUCKETS)
EXPLAINED_PARTS = (*BUCKET_PARTS, INDICATORS)


def r(expression: str, name: str | None = None) -> str:
    """Rounded like the Spark side, never minus zero."""
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0 AS {name or expression}"


def rs(names: Iterable[str]) -> str:
    return ", ".join(map(r, names))


def q(names: Iterable[str]) -> str:
    return ", ".join(f'"{c}"' for c in names)


def features(names: Iterable[str]) -> str:
    """Feature columns, ratios rounded."""
    return ", ".join(r(c) if c.endswith("_ratio") else c for c in names)


def sql(parts: Iterable[str], select: str) -> str:
    """Each table expression is computed once instead of being merged into the next."""
    tables = re.sub(r"(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", ",\n".join(parts))
    return f"WITH {tables}\n{select}"
