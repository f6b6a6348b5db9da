"""Golden and edge tests of the log features on small inline logs."""

from datetime import datetime

import pytest

from driftwarden import fixed
from driftwarden.operators import logs, schema

T = "user string, date timestamp_ntz"


def at(text):
    return datetime.fromisoformat(text) if text else None


def frame(spark, rows, columns):
    return spark.createDataFrame([(u, at(d), *rest) for u, d, *rest in rows], f"{T}, {columns}")


@pytest.fixture
def email(spark):
    return frame(
        spark,
        [
            ("EMP001", "2025-01-01 23:45:00", "test@gmail.com"),
            ("EMP001", "2025-01-01 23:50:00", "john@yahoo.com"),
            ("EMP001", "2025-01-02 10:00:00", "bob@company.com"),
            ("EMP002", "2025-01-03 09:00:00", "alice@company.com"),
            ("EMP002", "2025-01-04 23:30:00", "mark@gmail.com"),
        ],
        "to string",
    )


@pytest.fixture
def combined(spark):
    return frame(
        spark,
        [
            ("EMP001", "2025-01-01 23:45:00", "test@gmail.com", "Logon", "salary.xlsx", "USB"),
            ("EMP001", "2025-01-01 23:50:00", "john@yahoo.com", "Failed Login", "customer_data.csv", "USB"),
            ("EMP001", "2025-01-02 10:00:00", "bob@company.com", "Logon", "notes.txt", "Laptop"),
            ("EMP002", "2025-01-03 09:00:00", "alice@company.com", "Logon", "project.docx", "Desktop"),
            ("EMP002", "2025-01-04 23:30:00", "mark@gmail.com", "Logon", "backup.zip", "Mobile"),
            ("EMP003", "2025-01-05 01:15:00", "external@protonmail.com", "Failed Login", "employee_records.xlsx", "USB"),
            ("EMP003", "2025-01-05 01:20:00", "ceo@gmail.com", "Logon", "financial_report.pdf", "Unknown_Device"),
            ("EMP003", "2025-01-05 01:25:00", "board@gmail.com", "Logon", "confidential.zip", "USB"),
            ("EMP003", "2025-01-05 01:30:00", "outside@yahoo.com", "Logon", "payroll.xlsx", "Unknown_Device"),
            ("EMP003", "2025-01-05 01:35:00", "audit@gmail.com", "Failed Login", "employees.pdf", "USB"),
        ],
        "to string, activity string, file_name string, device string",
    )


def by_user(df):
    return {r.user: r.asDict() for r in df.collect()}


def pick(row, *names):
    return tuple(row[n] for n in names)


def test_email_log(email):
    got = by_user(logs.kind_features(email, "email"))
    names = ("email_count", "recipient_count", "external_count", "late_night_count", "weekend_count")
    assert pick(got["EMP001"], *names) == (3, 3, 2, 2, 0)
    assert pick(got["EMP002"], *names) == (2, 2, 1, 1, 1)
    assert got["EMP001"]["external_ratio"] == pytest.approx(2 / 3)
    assert got["EMP001"]["email_spike"] == 0


def test_logon_file_and_device_logs(spark):
    logon = frame(
        spark,
        [
            ("EMP001", "2025-01-01 23:45:00", "Logon"),
            ("EMP001", "2025-01-01 23:55:00", "Failed Login"),
            ("EMP001", "2025-01-02 10:00:00", "Logon"),
            ("EMP002", "2025-01-04 09:00:00", "Logon"),
            ("EMP002", "2025-01-04 23:30:00", "Logon"),
        ],
        "activity string",
    )
    got = by_user(logs.kind_features(logon, "logon"))
    names = ("login_count", "late_logins", "weekend_logins", "after_hours_logins", "failed_logins")
    assert pick(got["EMP001"], *names) == (3, 2, 0, 2, 1)
    assert pick(got["EMP002"], *names) == (2, 1, 2, 1, 0)

    files = frame(
        spark,
        [
            ("EMP001", "2025-01-01 23:30:00", "salary.xlsx", "Copy"),
            ("EMP001", "2025-01-01 23:45:00", "customer_data.csv", "Copy"),
            ("EMP001", "2025-01-02 10:00:00", "notes.txt", "Open"),
            ("EMP002", "2025-01-03 09:00:00", "project.docx", "Open"),
            ("EMP002", "2025-01-04 22:30:00", "backup.zip", "Copy"),
        ],
        "file_name string, activity string",
    )
    got = by_user(logs.kind_features(files, "file"))
    names = ("file_access_count", "file_copy_count", "sensitive_file_access",
             "after_hours_file_access", "weekend_file_access")
    assert pick(got["EMP001"], *names) == (3, 2, 2, 2, 0)
    assert pick(got["EMP002"], *names) == (2, 1, 2, 1, 1)

    devices = frame(
        spark,
        [
            ("EMP001", "2025-01-01 23:30:00", "USB"),
            ("EMP001", "2025-01-01 23:45:00", "USB"),
            ("EMP001", "2025-01-02 10:00:00", "Laptop"),
            ("EMP002", "2025-01-03 09:00:00", "Desktop"),
            ("EMP002", "2025-01-04 22:30:00", "Mobile"),
        ],
        "device string",
    )
    got = by_user(logs.kind_features(devices, "device"))
    names = ("device_activity_count", "usb_insertions", "unknown_device_count",
             "after_hours_device_usage", "weekend_device_usage")
    assert pick(got["EMP001"], *names) == (3, 2, 2, 2, 0)
    assert pick(got["EMP002"], *names) == (2, 0, 1, 1, 1)


def test_combined_log(combined):
    features = logs.log_features(combined)
    assert features.columns == ["user", *fixed.LOG_FEATURES]
    got = by_user(features)
    names = ("email_count", "recipient_count", "external_count", "late_night_count",
             "after_hours_logins", "weekend_count", "failed_logins", "file_copy_count",
             "sensitive_file_access", "usb_insertions", "unknown_device_count")
    assert pick(got["EMP001"], *names) == (3, 3, 2, 2, 2, 0, 1, 0, 2, 2, 2)
    assert pick(got["EMP002"], *names) == (2, 2, 1, 1, 1, 1, 0, 0, 2, 0, 1)
    assert pick(got["EMP003"], *names) == (5, 5, 5, 5, 5, 5, 2, 0, 5, 3, 5)


def test_missing_values_and_hours(spark):
    log = frame(
        spark,
        [
            ("a", None, None, None, None),
            ("a", "2025-01-06 18:59:00", "x@COMPANYxcom", "COPY fail", "X.PDF"),
            ("a", "2025-01-06 05:59:00", "x@Company.com", None, None),
            (None, "2025-01-06 05:59:00", "x@company.com", None, None),
        ],
        "to string, activity string, file_name string",
    )
    got = by_user(logs.log_features(log))
    assert set(got) == {"a"}
    row = got["a"]
    # A missing recipient is external and not counted; "." matches any character.
    assert pick(row, "email_count", "external_count") == (2, 1)
    assert by_user(logs.kind_features(log, "email", logs.LogSettings(domain="@companyxcom")))["a"][
        "external_count"
    ] == 2
    assert pick(row, "login_count", "late_logins", "after_hours_logins") == (2, 1, 1)
    assert pick(row, "failed_logins", "file_copy_count", "sensitive_file_access") == (1, 1, 1)


def test_missing_device_is_unknown_and_zero_counts_give_zero_ratios(spark):
    log = frame(spark, [("a", "2025-01-06 10:00:00", None)], "device string")
    row = by_user(logs.kind_features(log, "device"))["a"]
    assert pick(row, "device_activity_count", "unknown_device_count", "unknown_device_ratio") == (
        0, 1, 0.0,
    )


def test_external_pattern_accepts_any_character_for_the_dot(spark):
    log = frame(spark, [("a", "2025-01-06 10:00:00", "x@company-com")], "to string")
    assert by_user(logs.kind_features(log, "email"))["a"]["external_count"] == 0


def test_spike_uses_users_present_in_the_log_only(spark):
    busy = [("busy", "2025-01-06 10:00:00", "x@y")] * 50
    calm = [(f"u{i}", "2025-01-06 10:00:00", "x@y") for i in range(9)]
    email = frame(spark, busy + calm, "to string")
    logon = frame(
        spark, [(f"w{i}", "2025-01-06 10:00:00", "Logon") for i in range(500)], "activity string"
    )
    got = by_user(logs.log_features({"email": email, "logon": logon}))
    assert len(got) == 510
    assert got["busy"]["email_spike"] == 1
    # With the 500 users who sent nothing, one mail would be far above the mean.
    assert sum(r["email_spike"] for r in got.values()) == 1
    assert got["w0"]["email_count"] == 0 and got["busy"]["login_count"] == 0


def test_no_spike_with_five_or_fewer_users(spark):
    rows = [("busy", "2025-01-06 10:00:00", "x@y")] * 100
    rows += [(f"u{i}", "2025-01-06 10:00:00", "x@y") for i in range(4)]
    got = by_user(logs.kind_features(frame(spark, rows, "to string"), "email"))
    assert sum(r["email_spike"] for r in got.values()) == 0


def test_separate_logs_equal_merged_features(spark, combined):
    kinds = {k: combined.select(*fixed.REQUIRED_COLUMNS[k]) for k in fixed.LOG_KINDS}
    together = by_user(logs.log_features(kinds))
    built = [logs.kind_features(kinds[k], k) for k in fixed.LOG_KINDS]
    merged = by_user(logs.merge_features(built).select("user", *fixed.LOG_FEATURES))
    assert together == merged


def test_ready_features_pass_through_and_other_tables_fail(spark):
    ready = spark.createDataFrame([("a", *range(11))], ["user", *fixed.LOG_FEATURES[:11]])
    assert logs.log_features(ready).columns == ready.columns
    with pytest.raises(ValueError):
        logs.log_features(spark.createDataFrame([("a", 1)], ["user", "email_count"]))


def test_first_activity_prefers_critical_and_ignores_case(spark):
    log = frame(
        spark,
        [
            ("a", "2025-01-06 10:00:00", "logon", 1.0),
            ("a", "2025-01-06 11:00:00", "USB_copy", 2.5),
            ("a", "2025-01-06 12:00:00", "file_download", 1.5),
            ("b", "2025-01-06 12:00:00", "email", 1.0),
            ("b", "2025-01-06 11:00:00", None, 1.0),
        ],
        "activity string, risk_multiplier double",
    )
    got = by_user(logs.threat_signals(log))
    assert pick(got["a"], "activity", "risk_multiplier") == ("USB_copy", 2.5)
    assert got["b"]["activity"] == "email"


def test_signals_already_present_are_not_joined_again(spark):
    log = frame(spark, [("a", "2025-01-06 10:00:00", "logon", 3.0)], "activity string, risk_multiplier double")
    features = spark.createDataFrame([("a", 2.0)], "user string, risk_multiplier double")
    got = logs.forward_signals(features, log)
    assert got.columns == ["user", "risk_multiplier", "activity"]
    assert got.first().risk_multiplier == 2.0


# --- schema ------------------------------------------------------------------------


def test_names_kinds_and_duplicates(spark):
    df = spark.createDataFrame([("a", "b", "c")], [" User_ID", "TIME", "Recipient "])
    assert schema.canonical_names(df).columns == ["user", "date", "to"]
    with pytest.raises(ValueError):
        schema.canonical_names(spark.createDataFrame([("a", "b")], ["timestamp", "Time"]))
    assert schema.detect_kind(["User", " date", "to", "file_name"]) == "email"
    assert schema.detect_kind(["user", "date", "activity", "device"]) == "device"
    assert schema.detect_kind(fixed.FEATURE_MARKERS) == "features"
    assert schema.detect_kind(["user"]) == "unknown"
    assert schema.matching_kinds(["user", "date", "activity", "file_name"]) == ["logon", "file"]


def test_required_columns_and_alignment(spark):
    df = spark.createDataFrame([("a", 1, 2)], ["user", "x", "extra"])
    with pytest.raises(ValueError, match="to"):
        schema.require_columns(df, "email")
    with pytest.raises(ValueError):
        schema.require_columns(df, "nonsense")
    aligned, missing, extra = schema.align_to(df, ["y", "x"])
    assert (aligned.columns, missing, extra) == (["user", "y", "x"], ["y"], ["extra"])
    assert aligned.first().y == 0.0


def test_unparseable_dates(spark):
    from driftwarden.functions import parse_date

    df = spark.createDataFrame([("2025-01-01 01:02:03",), ("soon",)], ["d"])
    assert [r[0] for r in df.selectExpr(parse_date("d", strict=False)).collect()][1] is None
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.selectExpr(parse_date("d")).collect()


def test_a_user_with_a_third_of_all_rows(spark):
    """Counts and distinct recipients stay whole for a hot user."""
    rows = spark.range(0, 30_000, 1, 12).selectExpr(
        "if(id % 3 = 0, 'hot', concat('u', id % 500)) as user",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60) as date",
        "if(id % 11 = 0, null, concat('r', id % 997, '@mail.example')) as to",
    )
    got = by_user(logs.kind_features(rows, "email"))
    sent: dict[str, list] = {}
    for r in rows.collect():
        sent.setdefault(r.user, []).append(r.to)
    assert set(got) == set(sent)
    for user, recipients in sent.items():
        known = [t for t in recipients if t is not None]
        assert pick(got[user], "email_count", "recipient_count", "external_count") == (
            len(known), len(set(known)), len(recipients),
        )
    assert got["hot"]["email_spike"] == 1
