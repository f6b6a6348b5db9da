"""Profile and log scores: golden values, edge rules, bounds."""

import pytest

from driftwarden import fixed
from driftwarden.functions import number
from driftwarden.operators import evaluation, profiles, reports, scoring
from driftwarden.operators.forest import rounded_suspicion, suspicion
from driftwarden.plans import flows
from driftwarden.session import materialize
from driftwarden.sources.events import user_profiles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def profile(spark):
    return materialize(user_profiles(spark, SF))


@pytest.fixture(scope="module")
def scored(profile):
    return materialize(flows.assess_profiles(profile))


def test_feature_count(profile):
    names = [c for p in fixed.PILLARS.values() for c in p]
    features = profiles.profile_features(profile.select("user", *[c for c in fixed.PROFILE_INPUTS if c in profile.columns]))
    assert len(names) == 54
    assert set(names) <= set(features.columns)
    # Five features replace an input of the same name.
    assert len(features.columns) - len(fixed.PROFILE_INPUTS) - 1 == 49


def test_profile_bounds(profile, scored):
    raw = profiles.ProfileFeatures(profile).table().select(
        *[c for c in fixed.COMPOSITES]
    )
    for row in raw.collect():
        assert all(0 <= v <= 1 for v in row)
    rows = scored.collect()
    assert len(rows) == profile.count() == len({r.user for r in rows})
    for r in rows:
        assert all(0 <= r[f"score_tier_{t.lower()}"] <= 1 for t in fixed.TIER_MULTIPLIERS)
    base = [r.base_risk_score for r in rows]
    assert min(base) == pytest.approx(0) and max(base) == pytest.approx(100)
    high = sum(r.risk_tier == "High" for r in rows)
    assert high >= 0.1 * len(rows)
    assert all(r.anomaly_model_score is None for r in rows)


def test_missing_active_days_counts_as_one(spark, profile):
    with_days = profile.drop("active_days")
    got = profiles.pillar(with_days, "email").first()
    assert got.off_hours_email_ratio is not None


def test_equal_scores_are_all_high(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0)], "user string, final_risk_score double")
    assert {r.risk_tier for r in scoring.bucket(df).collect()} == {"High"}


def test_indicators_need_a_positive_value(spark):
    df = spark.createDataFrame(
        [("a", 0, 0.0), ("b", 0, -1.0), ("c", 0, 2.0)],
        "user string, malicious_url_flag int, ext_email_ratio_zscore double",
    )
    got = {r.user: r.risk_indicators for r in scoring.explain_indicators(df).collect()}
    assert got == {
        "a": "No significant indicators",
        "b": "No significant indicators",
        "c": "[HIGH] External email ratio spike",
    }


def test_missing_indicators_count_as_zero(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "user string, bcc_abuse_flag double")
    rows = {r.user: r for r in scoring.base_risk(scoring.tier_scores(df)).collect()}
    assert rows["a"].score_tier_critical == pytest.approx(7 / 51)
    assert rows["b"].base_risk_score == 0 and rows["a"].base_risk_score == 100


def test_log_rules(spark):
    columns = "user string, external_ratio double, usb_ratio double, anomaly int, activity string, risk_multiplier double"
    df = spark.createDataFrame(
        [
            ("quiet", 0.1, 0.0, 0, "logon", 1.0),
            ("model", 0.1, 0.0, 1, "logon", 1.0),
            ("boost", 0.6, 0.6, 0, "USB_Copy", 1.0),
            ("minor", 0.6, 0.0, 0, "email", None),
            ("multi", 0.0, 0.0, 0, None, 2.0),
            ("empty", None, None, None, None, None),
        ],
        columns,
    )
    got = {r.user: (round(r.risk_score, 6), r.risk_level, r.reason) for r in scoring.apply_rules(df).collect()}
    assert got["quiet"] == (2.0, "Low", fixed.NO_REASON)
    assert got["model"][:2] == (75.0, "High")
    assert got["boost"] == (
        63.0, "Medium", "High external email communication | Heavy USB device usage",
    )
    assert got["minor"][:2] == (27.0, "Low")
    assert got["multi"][:2] == (85.0, "High")
    assert got["empty"][:2] == (0.0, "Low")


def test_suspicion_forms_differ_without_spread(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "user string, d double")
    assert {r.s for r in suspicion(df, "d", "s").collect()} == {0.0}
    assert {r.s for r in rounded_suspicion(df, "d", "s").collect()} == {100.0}


def test_published_scores(spark):
    df = spark.createDataFrame(
        [("a", -0.2), ("b", 0.0), ("c", -0.1)], "user string, anomaly_score double"
    )
    rows = profiles.published_risk_level(profiles.published_risk_score(df)).collect()
    assert {r.user: (round(r.risk_score, 6), r.risk_level) for r in rows} == {
        "a": (100.0, "High"), "b": (0.0, "Low"), "c": (50.0, "Medium"),
    }


def test_derived_formulas_on_a_published_row(spark):
    row = {
        "after_hours_logons": 741.04, "emails_sent_off_hours": 0.0,
        "avg_after_hours_browsing_per_day": 0.0, "active_days": 346.22,
        "late_hour_device_use": 365.29, "missing_disconnects": 17, "distinct_pcs_used": 4.89,
        "weekend_logons": 77.0, "logons_on_other_user_pcs": 1048.03, "filetype_exe": 57.01,
        "filetype_zip": 422.04, "after_hours_file_copy_ratio": 0.178232154,
        "external_emails_ratio": 0.512478685, "emails_sent_per_day": 10.52815013,
        "attachment_count_avg": 0.563279857,
        **{f"risk_score_{i}": v for i, v in enumerate((0.5, 0.6, 1.0, 0.4, 1.8), 1)},
    }
    got = profiles.add_derived(spark.createDataFrame([row])).first()
    assert got.after_hours_intensity == pytest.approx(741.04)
    assert got.file_risk_composite == pytest.approx(1016.892322, abs=1e-6)
    assert got.email_exfil_score == pytest.approx(3.039149738, abs=1e-8)
    assert got.device_anomaly_score == pytest.approx(404.18)
    assert got.logon_suspicion == pytest.approx(2914.1)
    assert got.total_risk_score == pytest.approx(4.3)


def test_reports(spark):
    df = spark.createDataFrame(
        [("b", 90.0, "High"), ("a", 90.0, "High"), ("c", 10.0, "Low")],
        "user string, risk_score double, risk_level string",
    )
    levels = {r.risk_level: (r.n, round(r.pct, 2)) for r in reports.level_distribution(df).collect()}
    assert levels == {"High": (2, 66.67), "Medium": (0, 0.0), "Low": (1, 33.33)}
    assert [r.user for r in reports.top(df, 2).collect()] == ["a", "b"]
    assert reports.highest_row(df, ["user", "risk_score"]).first().user == "a"
    bins = {r.bin: r.n for r in reports.histogram(
        spark.createDataFrame([(0.0,), (100.0,), (99.0,), (5.0,)], "anomaly_score double")).collect()}
    assert len(bins) == 20 and (bins[1], bins[2], bins[20]) == (1, 1, 2)


def test_evaluation_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, anomaly int")
    got = evaluation.classification_metrics(df).first()
    assert (got.accuracy, got.precision, got.recall, got.f1_score, got.roc_auc) == (1, 0, 0, 0, None)
    cells = {(r.label, r.predicted): r.n for r in evaluation.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 0}


def test_histogram_keeps_scores_beyond_the_ends_and_missing_ones(spark):
    df = spark.createDataFrame([(-3.0,), (None,), (float("nan"),), (50.0,), (150.0,)], "anomaly_score double")
    bins = {r.bin: r.n for r in reports.histogram(df).collect() if r.n}
    assert bins == {1: 1, 11: 1, 20: 1, None: 2}


def test_literals_that_are_not_finite(spark):
    row = spark.range(1).selectExpr(f"{number(float('inf'))} as a", f"{number(float('-inf'))} as b").first()
    assert (row.a, row.b) == (float("inf"), float("-inf"))
