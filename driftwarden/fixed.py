"""Fixed values.

Column names, word lists, weights, cut-offs and texts that results depend on.
They are data, not logic; everything here can be overridden through keyword
arguments of the operators that use it.
"""

from __future__ import annotations

# --- fixed values: event logs -------------------------------------------------

COLUMN_ALIASES = {
    "employee_id": "user",
    "userid": "user",
    "user_id": "user",
    "empid": "user",
    "timestamp": "date",
    "datetime": "date",
    "time": "date",
    "recipient": "to",
    "receiver": "to",
    "mail_to": "to",
    "filename": "file_name",
    "usb_device": "device",
}

REQUIRED_COLUMNS = {
    "email": ("user", "date", "to"),
    "logon": ("user", "date", "activity"),
    "file": ("user", "date", "file_name"),
    "device": ("user", "date", "device"),
    "features": ("user",),
}

# Columns that mark a table of ready features, and the order in which a single
# kind is looked for.
FEATURE_MARKERS = ("email_count", "late_night", "external_ratio")
DETECTION_ORDER = ("email", "file", "device", "logon")
LOG_KINDS = ("email", "logon", "file", "device")

COMPANY_DOMAIN = "@company.com"
FAILURE_WORD = "fail"
COPY_WORD = "copy"
USB_WORD = "usb"
SENSITIVE_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".csv", ".zip")
TRUSTED_DEVICES = ("laptop", "desktop", "workstation", "company_pc")
CRITICAL_ACTIVITIES = ("usb_copy", "file_download", "malicious_url_click")
NOTABLE_ACTIVITIES = ("email", "file_write")

LATE_FROM, LATE_UNTIL = 22, 5
WORK_FROM, WORK_UNTIL = 8, 18
SPIKE_SIGMAS = 2.0

# The 36 features of the log flow, in model order.
LOG_FEATURES = (
    "email_count",
    "recipient_count",
    "external_count",
    "late_night_count",
    "weekend_count",
    "external_ratio",
    "late_night_ratio",
    "weekend_ratio",
    "email_spike",
    "login_count",
    "late_logins",
    "weekend_logins",
    "after_hours_logins",
    "failed_logins",
    "late_login_ratio",
    "weekend_login_ratio",
    "after_hours_ratio",
    "login_spike",
    "file_access_count",
    "file_copy_count",
    "sensitive_file_access",
    "after_hours_file_access",
    "weekend_file_access",
    "copy_ratio",
    "sensitive_ratio",
    "after_hours_file_ratio",
    "file_spike",
    "device_activity_count",
    "usb_insertions",
    "unknown_device_count",
    "after_hours_device_usage",
    "weekend_device_usage",
    "usb_ratio",
    "unknown_device_ratio",
    "after_hours_device_ratio",
    "device_spike",
)

# A table counts as ready features when it has more than this many of the 36.
READY_FEATURES_ABOVE = 10

# --- fixed values: rule score of the log flow ---------------------------------

RULE_WEIGHTS = {
    "external_ratio": 20.0,
    "late_night_ratio": 15.0,
    "after_hours_ratio": 15.0,
    "weekend_login_ratio": 10.0,
    "copy_ratio": 15.0,
    "sensitive_ratio": 10.0,
    "usb_ratio": 10.0,
    "unknown_device_ratio": 5.0,
}
CRITICAL_BOOST = 45.0
NOTABLE_BOOST = 15.0
ANOMALY_FLOOR = 75.0
MULTIPLIER_CUT = 2.0
MULTIPLIER_FLOOR = 85.0
LEVEL_CUTS = (("High", 70.0), ("Medium", 40.0))
LEVELS = ("High", "Medium", "Low")

# column, cut, text
REASONS = (
    ("external_ratio", 0.5, "High external email communication"),
    ("late_night_ratio", 0.3, "Frequent late-night activity"),
    ("weekend_login_ratio", 0.3, "Frequent weekend access"),
    ("copy_ratio", 0.5, "High file copy activity"),
    ("sensitive_ratio", 0.5, "Sensitive file access"),
    ("usb_ratio", 0.5, "Heavy USB device usage"),
    ("unknown_device_ratio", 0.3, "Unknown device detected"),
)
NO_REASON = "No major threat indicators detected"
TEXT_SEPARATOR = " | "

# --- fixed values: weighted indicator tiers of the profile flow ---------------

# column, weight, tier, text
INDICATORS = (
    ("malicious_url_flag", 10.0, "CRITICAL", "Any malicious URL access"),
    ("malicious_url_zscore", 8.0, "CRITICAL", "Malicious URL spike vs population"),
    ("after_hours_file_spike", 8.0, "CRITICAL", "After-hours file copy anomaly"),
    ("bcc_abuse_flag", 7.0, "CRITICAL", "BCC usage rate anomaly (data hiding)"),
    ("email_file_exfil_chain", 9.0, "CRITICAL", "Email + file exfiltration combo"),
    ("exfil_chain_score", 9.0, "CRITICAL", "Multi-pillar exfiltration chain"),
    ("ext_email_ratio_zscore", 6.0, "HIGH", "External email ratio spike"),
    ("off_hours_email_ratio", 6.0, "HIGH", "Off-hours email proportion"),
    ("risky_filetype_score", 5.0, "HIGH", "EXE + ZIP file copy ratio"),
    ("after_hours_file_ratio", 6.0, "HIGH", "After-hours file copy ratio"),
    ("other_pc_logon_flag", 5.0, "HIGH", "Logons on other users PCs"),
    ("lateral_movement_score", 5.0, "HIGH", "Multi-PC + other-user logon combo"),
    ("dual_off_hours_signal", 5.0, "HIGH", "Concurrent off-hours email + file"),
    ("network_file_chain", 5.0, "HIGH", "Malicious URL + risky file types"),
    ("after_hours_logon_zscore", 3.0, "MEDIUM", "After-hours logon frequency spike"),
    ("weekend_logon_flag", 3.0, "MEDIUM", "Weekend logon presence"),
    ("files_copy_volume_zscore", 3.0, "MEDIUM", "File copy volume spike"),
    ("domain_spread_zscore", 3.0, "MEDIUM", "Unusually many distinct domains"),
    ("missing_disc_zscore", 2.0, "MEDIUM", "Missing device disconnects"),
    ("never_used_device_flag", 3.0, "MEDIUM", "New/never-used device suddenly active"),
    ("high_attachment_flag", 2.0, "MEDIUM", "High email attachment density"),
    ("sensitive_doc_ratio", 2.0, "MEDIUM", "High PDF/DOC copy ratio"),
    ("after_hours_browse_flag", 2.0, "MEDIUM", "After-hours browsing"),
    ("attachment_density", 1.0, "LOW", "Average email attachment count"),
    ("multi_pc_flag", 1.0, "LOW", "Multiple PCs used"),
    ("logon_erratic_flag", 1.0, "LOW", "Erratic logon time variability"),
    ("recipient_spread_zscore", 1.0, "LOW", "Wide email recipient spread"),
    ("device_conn_zscore", 0.5, "LOW", "Device connection frequency"),
)
TIER_MULTIPLIERS = {"CRITICAL": 2.5, "HIGH": 1.5, "MEDIUM": 0.8, "LOW": 0.3}
EXPLAINED_TIERS = ("CRITICAL", "HIGH")
INDICATOR_QUANTILE = 0.75
NO_INDICATOR = "No significant indicators"
BUCKET_QUANTILES = (0.70, 0.90)
BLEND = (0.70, 0.30)

# --- fixed values: profile features -------------------------------------------

ZSCORE_EPSILON = 1e-9

# z-score column -> profile column it standardises
PROFILE_ZSCORES = {
    "ext_email_ratio_zscore": "external_emails_ratio",
    "recipient_spread_zscore": "unique_recipients_count",
    "files_copy_volume_zscore": "total_files_copied",
    "after_hours_logon_zscore": "after_hours_logons",
    "malicious_url_zscore": "avg_malicious_urls_per_day",
    "domain_spread_zscore": "avg_distinct_domains_per_day",
    "missing_disc_zscore": "missing_disconnects",
    "device_conn_zscore": "avg_daily_device_connections",
}

# flag column -> (profile column, quantile it must exceed)
PROFILE_QUANTILE_FLAGS = {
    "bcc_abuse_flag": ("bcc_usage_rate", 0.90),
    "high_attachment_flag": ("attachment_count_avg", 0.90),
    "after_hours_file_spike": ("after_hours_file_copy_ratio", 0.85),
    "weekend_logon_flag": ("weekend_logons", 0.80),
    "logon_erratic_flag": ("logon_std_dev_hours", 0.85),
    "after_hours_browse_flag": ("avg_after_hours_browsing_per_day", 0.80),
}

# composite -> ((weight, feature, form), ...); form "sigma" is clip(0, 5) / 5,
# "unit" is clip(0, 1), "plain" is the feature itself
COMPOSITES = {
    "email_exfil_composite": (
        (0.35, "ext_email_ratio_zscore", "sigma"),
        (0.25, "off_hours_email_ratio", "unit"),
        (0.20, "bcc_usage_rate", "unit"),
        (0.10, "high_attachment_flag", "plain"),
        (0.10, "recipient_spread_zscore", "sigma"),
    ),
    "file_staging_composite": (
        (0.30, "files_copy_volume_zscore", "sigma"),
        (0.30, "after_hours_file_ratio", "unit"),
        (0.25, "risky_filetype_score", "plain"),
        (0.15, "sensitive_doc_ratio", "plain"),
    ),
    "temporal_anomaly_composite": (
        (0.30, "after_hours_logon_zscore", "sigma"),
        (0.20, "weekend_logon_flag", "plain"),
        (0.25, "other_pc_logon_flag", "plain"),
        (0.15, "logon_erratic_flag", "plain"),
        (0.10, "late_hour_device_use", "unit"),
    ),
    "network_anomaly_composite": (
        (0.40, "malicious_url_zscore", "sigma"),
        (0.20, "malicious_url_flag", "plain"),
        (0.25, "domain_spread_zscore", "sigma"),
        (0.15, "after_hours_browse_flag", "plain"),
    ),
    "device_anomaly_composite": (
        (0.25, "multi_pc_flag", "plain"),
        (0.25, "missing_disc_zscore", "sigma"),
        (0.25, "never_used_device_flag", "plain"),
        (0.25, "device_conn_zscore", "sigma"),
    ),
    "exfil_chain_score": (
        (0.30, "email_exfil_composite", "plain"),
        (0.25, "file_staging_composite", "plain"),
        (0.20, "temporal_anomaly_composite", "plain"),
        (0.15, "network_anomaly_composite", "plain"),
        (0.10, "device_anomaly_composite", "plain"),
    ),
}

# Product features of two signals from different pillars.
CHAINS = {
    "email_file_exfil_chain": ("email_exfil_composite", "file_staging_composite"),
    "dual_off_hours_signal": ("off_hours_email_ratio", "temporal_anomaly_composite"),
    "network_file_chain": ("malicious_url_flag", "risky_filetype_score"),
    "lateral_movement_score": ("multi_pc_flag", "other_pc_logon_flag"),
}

# Engineered columns per pillar, in output order.
PILLARS = {
    "email": (
        "ext_email_ratio",
        "ext_email_ratio_zscore",
        "off_hours_email_count",
        "off_hours_email_ratio",
        "bcc_abuse_flag",
        "bcc_usage_rate",
        "attachment_density",
        "high_attachment_flag",
        "unique_recipient_count",
        "recipient_spread_zscore",
        "email_exfil_composite",
    ),
    "file": (
        "total_files_copied",
        "avg_files_per_day",
        "files_copy_volume_zscore",
        "after_hours_file_ratio",
        "after_hours_file_spike",
        "exe_file_ratio",
        "zip_file_ratio",
        "risky_filetype_score",
        "sensitive_doc_ratio",
        "file_staging_composite",
    ),
    "temporal": (
        "after_hours_logon_count",
        "after_hours_logon_zscore",
        "weekend_logon_count",
        "weekend_logon_flag",
        "other_pc_logon_count",
        "other_pc_logon_flag",
        "logon_time_std",
        "logon_erratic_flag",
        "late_hour_device_use",
        "off_hours_intensity",
        "temporal_anomaly_composite",
    ),
    "network": (
        "malicious_url_avg",
        "malicious_url_total",
        "malicious_url_flag",
        "malicious_url_zscore",
        "distinct_domain_avg",
        "domain_spread_zscore",
        "after_hours_browsing_avg",
        "after_hours_browse_flag",
        "network_anomaly_composite",
    ),
    "device": (
        "distinct_pcs_used",
        "multi_pc_flag",
        "missing_disconnects",
        "missing_disc_zscore",
        "never_used_device_flag",
        "avg_device_connections",
        "device_conn_zscore",
        "device_anomaly_composite",
    ),
    "chains": (
        "email_file_exfil_chain",
        "dual_off_hours_signal",
        "network_file_chain",
        "lateral_movement_score",
        "exfil_chain_score",
    ),
}

ROBUST_SCALED = (
    "ext_email_ratio_zscore",
    "recipient_spread_zscore",
    "email_exfil_composite",
    "files_copy_volume_zscore",
    "risky_filetype_score",
    "file_staging_composite",
    "after_hours_logon_zscore",
    "temporal_anomaly_composite",
    "malicious_url_zscore",
    "domain_spread_zscore",
    "network_anomaly_composite",
    "missing_disc_zscore",
    "device_conn_zscore",
    "device_anomaly_composite",
    "lateral_movement_score",
    "exfil_chain_score",
)

LOG1P_COLUMNS = (
    "avg_daily_device_connections",
    "late_hour_device_use",
    "missing_disconnects",
    "distinct_pcs_used",
    "above_avg_daily_counter",
    "emails_sent_off_hours",
    "total_files_copied",
    "active_days",
    "avg_files_copied_per_day",
    "filetype_doc",
    "filetype_exe",
    "filetype_jpg",
    "filetype_pdf",
    "filetype_txt",
    "filetype_zip",
    "avg_malicious_urls_per_day",
    "total_malicious_urls",
    "avg_after_hours_browsing_per_day",
    "logon_std_dev_hours",
    "after_hours_logons",
    "weekend_logons",
    "logons_on_other_user_pcs",
)

# Fixed cuts that fit the published score table.
PUBLISHED_LEVEL_CUTS = (("High", 75.0), ("Medium", 45.0))

# --- fixed values: inputs of the profile features ------------------------------

PROFILE_INPUTS = (
    "external_emails_ratio",
    "emails_sent_off_hours",
    "emails_sent_per_day",
    "active_days",
    "bcc_usage_rate",
    "attachment_count_avg",
    "unique_recipients_count",
    "total_files_copied",
    "avg_files_copied_per_day",
    "after_hours_file_copy_ratio",
    "filetype_exe",
    "filetype_zip",
    "filetype_pdf",
    "filetype_doc",
    "after_hours_logons",
    "weekend_logons",
    "logons_on_other_user_pcs",
    "logon_std_dev_hours",
    "late_hour_device_use",
    "after_hours_intensity",
    "avg_malicious_urls_per_day",
    "total_malicious_urls",
    "avg_distinct_domains_per_day",
    "avg_after_hours_browsing_per_day",
    "distinct_pcs_used",
    "missing_disconnects",
    "never_used_device",
    "avg_daily_device_connections",
)

# Inputs that may be absent, and what stands in for them.
OPTIONAL_INPUTS = {"after_hours_intensity": 0.0, "active_days": 1.0}

# Features that are an input with its gaps filled.
COPIED = {
    "ext_email_ratio": "external_emails_ratio",
    "off_hours_email_count": "emails_sent_off_hours",
    "bcc_usage_rate": "bcc_usage_rate",
    "attachment_density": "attachment_count_avg",
    "unique_recipient_count": "unique_recipients_count",
    "total_files_copied": "total_files_copied",
    "avg_files_per_day": "avg_files_copied_per_day",
    "after_hours_file_ratio": "after_hours_file_copy_ratio",
    "after_hours_logon_count": "after_hours_logons",
    "weekend_logon_count": "weekend_logons",
    "other_pc_logon_count": "logons_on_other_user_pcs",
    "logon_time_std": "logon_std_dev_hours",
    "late_hour_device_use": "late_hour_device_use",
    "off_hours_intensity": "after_hours_intensity",
    "malicious_url_avg": "avg_malicious_urls_per_day",
    "malicious_url_total": "total_malicious_urls",
    "distinct_domain_avg": "avg_distinct_domains_per_day",
    "after_hours_browsing_avg": "avg_after_hours_browsing_per_day",
    "distinct_pcs_used": "distinct_pcs_used",
    "missing_disconnects": "missing_disconnects",
    "avg_device_connections": "avg_daily_device_connections",
}

# Flags for an input over a fixed count.
COUNT_FLAGS = {
    "other_pc_logon_flag": ("logons_on_other_user_pcs", 0),
    "malicious_url_flag": ("total_malicious_urls", 0),
    "multi_pc_flag": ("distinct_pcs_used", 1),
    "never_used_device_flag": ("never_used_device", 0),
}

# Shares of a file type among all copies.
FILE_SHARES = {"exe_file_ratio": "filetype_exe", "zip_file_ratio": "filetype_zip"}

# --- fixed values: training layout and model ----------------------------------

# Targets that are a profile column under another name.
TRAINING_COPIES = {
    "email_count": "emails_sent_per_day",
    "recipient_count": "unique_recipients_count",
    "late_night_count": "emails_sent_off_hours",
    "external_ratio": "external_emails_ratio",
    "late_logins": "after_hours_logons",
    "weekend_logins": "weekend_logons",
    "after_hours_logins": "after_hours_logons",
    "file_access_count": "total_files_copied",
    "file_copy_count": "total_files_copied",
    "after_hours_file_ratio": "after_hours_file_copy_ratio",
    "device_activity_count": "avg_daily_device_connections",
    "usb_insertions": "avg_daily_device_connections",
    "unknown_device_count": "never_used_device",
    "after_hours_device_usage": "late_hour_device_use",
}
TRAINING_CONSTANTS = {
    "weekend_count": 0,
    "weekend_ratio": 0,
    "failed_logins": 0,
    "weekend_file_access": 0,
    "copy_ratio": 1,
    "weekend_device_usage": 0,
}
# target -> (part, whole), both training columns, as part / (whole + 1)
TRAINING_RATIOS = {
    "late_night_ratio": ("late_night_count", "email_count"),
    "late_login_ratio": ("late_logins", "login_count"),
    "weekend_login_ratio": ("weekend_logins", "login_count"),
    "after_hours_ratio": ("after_hours_logins", "login_count"),
    "sensitive_ratio": ("sensitive_file_access", "file_access_count"),
    "usb_ratio": ("usb_insertions", "device_activity_count"),
    "unknown_device_ratio": ("unknown_device_count", "device_activity_count"),
    "after_hours_device_ratio": ("after_hours_device_usage", "device_activity_count"),
}
TRAINING_SPIKES = {
    "email_spike": "email_count",
    "login_spike": "login_count",
    "file_spike": "file_access_count",
    "device_spike": "device_activity_count",
}

TRAINING_SPIKE_QUANTILE = 0.95
NOT_MODEL_FEATURES = ("user", "label", "odd_onboarding")
CONTAMINATION = 0.05
PROFILE_TREES = 200
LOG_TREES = 300
MODEL_SEED = 42
TREE_SAMPLE = 256
