"""CSV details: byte-order mark, empty cells, strictness, round trips."""

import pytest

from driftwarden.operators import logs, schema
from driftwarden.session import scratch_path
from driftwarden.sources import tables


def test_byte_order_mark_and_empty_cells(spark, tmp_path):
    path = tmp_path / "email.csv"
    path.write_bytes(
        "﻿user,date,to\nEMP001,2025-01-01 23:45:00,a@b.c\nEMP001,,\n".encode()
    )
    log = tables.read_log(spark, str(path), "email")
    assert log.columns == ["user", "date", "to"]
    rows = log.collect()
    assert rows[0].user == "EMP001" and rows[1].date is None and rows[1].to is None
    got = logs.kind_features(log, "email").first()
    assert (got.email_count, got.external_count, got.late_night_count) == (1, 2, 1)


def test_strict_and_permissive_reading(spark, tmp_path):
    path = tmp_path / "logon.csv"
    path.write_text("user,date,activity\na,whenever,Logon\n")
    with pytest.raises(Exception):
        tables.read_log(spark, str(path), "logon").collect()
    log = tables.read_log(spark, str(path), "logon", strict=False)
    assert schema.row_problems({"logon": log}).first().bad_dates == 1
    with pytest.raises(Exception):
        logs.kind_features(log, "logon").collect()
    loose = logs.LogSettings(strict_dates=False)
    assert logs.kind_features(log, "logon", loose).first().login_count == 0


def test_text_dates_with_a_format(spark):
    log = spark.createDataFrame([("a", "01/02/2010 23:49:00", "x@y.z")], "user string, date string, to string")
    form = logs.LogSettings(date_format="MM/dd/yyyy HH:mm:ss")
    assert logs.log_features(log, form).first().late_night_count == 1


def test_round_trip_keeps_doubles(spark):
    df = spark.createDataFrame([("a", 0.1 + 0.2, 3)], "user string, x double, missing_disconnects long")
    for suffix in (".csv", ".parquet"):
        path = tables.write_table(df, scratch_path(spark, "trip") + suffix)
        read = tables.read_profile(spark, path, df.columns)
        assert read.first() == df.first() and read.dtypes == df.dtypes


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "file.csv"
    path.write_text("user,date,activity,file_name\na,2025-01-01 10:00:00,Copy,salary.xlsx\n")
    row = tables.read_log(spark, str(path), "file").first()
    assert (row.activity, row.file_name) == ("Copy", "salary.xlsx")


def test_aliases_extras_and_date_format(spark, tmp_path):
    path = tmp_path / "email.csv"
    path.write_text("Recipient,Timestamp,User_ID,note\nx@y.z,01/31/2010 06:49:00,EMP1,hi\n")
    log = tables.read_log(spark, str(path), "email", date_format="MM/dd/yyyy HH:mm:ss")
    assert log.columns == ["user", "date", "to", "note"]
    row = log.first()
    assert (row.user, row.to, row.note, row.date.month) == ("EMP1", "x@y.z", "hi", 1)


def test_missing_columns_raise_and_nan_is_null(spark, tmp_path):
    path = tmp_path / "profile.csv"
    path.write_text("risk_score_1,user\nNaN,a\n2.5,b\n")
    rows = tables.read_profile(spark, str(path), ["user", "risk_score_1"]).collect()
    assert [r.risk_score_1 for r in rows] == [None, 2.5]
    with pytest.raises(ValueError):
        tables.read_profile(spark, str(path), ["user", "risk_score_2"])


def test_bad_dates_of_any_format_are_counted_and_shown(spark, tmp_path):
    for form, good in ((None, "2010-01-31 06:49:00"), ("MM/dd/yyyy HH:mm:ss", "01/31/2010 06:49:00")):
        path = tmp_path / f"logon-{form is None}.csv"
        path.write_text(f"user,date,activity\na,whenever,Logon\nb,{good},Logon\nc,,Logon\n")
        log = {"logon": tables.read_log(spark, str(path), "logon", strict=False, date_format=form)}
        row = schema.row_problems(log, form).first()
        assert (row.row_count, row.null_users, row.bad_dates) == (3, 0, 1)
        assert [tuple(r) for r in schema.bad_dates(log, form).collect()] == [("logon", "a", "whenever")]
        loose = logs.LogSettings(date_format=form, strict_dates=False)
        counts = {r.user: r.login_count for r in logs.kind_features(log["logon"], "logon", loose).collect()}
        assert counts == {"a": 0, "b": 1, "c": 0}


def test_ids_stay_with_their_rows(spark):
    rows = [(x, float(x % 3)) for x in range(60)] + [(7, 1.0)] * 40
    df = spark.createDataFrame(rows, "x int, y double")
    found = [
        sorted((r.user, r.x, r.y) for r in schema.ensure_user(df.repartition(n)).collect()) for n in (1, 7, 200)
    ]
    assert found[0] == found[1] == found[2]
    assert sorted(int(u) for u, _, _ in found[0]) == list(range(100))
    assert schema.ensure_user(df.withColumnRenamed("x", "user")).columns == ["user", "y"]
    assert schema.ensure_user(df.limit(0)).collect() == []


def test_what_a_table_is_filed_under():
    kinds = {
        "user,date,to": ["email"], "user,date,file_name,activity": ["file"], "user,date,activity": ["logon"],
        "user,date,to,activity,file_name,device": ["email", "logon", "file", "device"],
        "user,date,to,device": ["email", "device"], "user,date": ["unknown"],
    }
    for columns, want in kinds.items():
        assert schema.filed_under(columns.split(",")) == want
