"""Exact quantiles with much and little room, and the numeric edge rules."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftwarden.operators import statistics as stats


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize("kind", ["spread", "heavy", "binary", "tiny", "wide"])
def test_quantiles_equal_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=20_000),
        # A third of all rows share one value.
        "heavy": np.where(rng.random(20_000) < 0.34, 1.5, rng.normal(size=20_000)),
        "binary": (rng.random(20_000) < 0.9).astype(float),
        "tiny": rng.random(7),
        "wide": np.exp(rng.normal(scale=60, size=20_000)),
    }[kind]
    at = [0.0, 0.05, 0.25, 0.5, 0.7, 0.9, 1.0]
    df = column(spark, values.tolist() + [None]).repartition(5)
    got = stats.quantiles(df, {"x": at})["x"]
    for p in at:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.floats(0, 1))
def test_drawn_quantiles_equal_brute_force(spark, values, p):
    got = stats.quantiles(column(spark, values), {"x": [p]})["x"][p]
    assert got == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-6)


def test_jobs_do_not_grow_with_rows(spark, monkeypatch):
    """One count of cells for whole numbers, two for most others, at any size."""
    jobs = []
    counted = stats._counted
    monkeypatch.setattr(stats, "_counted", lambda *a: jobs.append(1) or counted(*a))
    for rows in (50, 200_000):
        df = spark.range(rows).selectExpr("cast(id % 900 as double) as whole", "id / 7 + sqrt(id) as x", "id as n")
        jobs.clear()
        stats.quantiles(df, {"whole": [0.1, 0.5]})
        assert len(jobs) == 1
        jobs.clear()
        stats.quantiles(df, {"x": [0.25, 0.9], "n": [0.3]})
        assert len(jobs) <= 3


def test_quantiles_of_nothing(spark):
    df = column(spark, [None, None])
    assert stats.quantiles(df, {"x": [0.5]})["x"][0.5] is None


def test_quantiles_with_values_that_are_not_finite(spark):
    df = column(spark, [1.0, 2.0, 3.0, float("inf"), float("nan")])
    got = stats.quantiles(df, {"x": [0.0, 1 / 3, 2 / 3, 1.0]})["x"]
    assert list(got.values()) == [1.0, 2.0, 3.0, float("inf")]


def test_nan_is_missing(spark):
    nan = float("nan")
    plain, holed = [1.0, 2.0, 3.0, 7.0, None], [1.0, 2.0, 3.0, 7.0, nan]
    for operator in (
        lambda df: stats.add_zscores(df, {"y": "x"}),
        lambda df: stats.add_quantile_flags(df, {"y": ("x", 0.7)}),
        lambda df: stats.add_spikes(df, {"y": "x"}),
        lambda df: stats.add_unit_range(df, {"y": "x"}),
        lambda df: stats.robust_scale(df, ["x"]),
        lambda df: stats.impute_medians(df, ["x"]),
        lambda df: stats.Scaler.fit(df, ["x"]).transform(df),
        lambda df: stats.summary_table(df, ["x"], ("n", "mean", "sd", "lo", "hi")),
    ):
        want, got = ([tuple(r) for r in operator(column(spark, v)).collect()] for v in (plain, holed))
        assert got == want
    floats = column(spark, holed).selectExpr("cast(x as float) as x", "1 as n", "'a' as t")
    assert [r.x for r in stats.without_nan(floats, ["x", "n", "t"]).collect()] == plain


def test_two_values_that_fill_a_bracket(spark):
    df = spark.range(5000).selectExpr("cast(id % 2 as double) as x").union(column(spark, [0.4, 0.5]))
    got = stats.quantiles(df, {"x": [0.5, 0.2, 0.9]})["x"]
    assert got == {0.5: 0.45, 0.2: 0.0, 0.9: 1.0}


def test_one_row_has_no_deviation(spark):
    row = stats.add_zscores(column(spark, [3.0]), {"z": "x"}).first()
    assert row.z is None
    assert stats.add_spikes(column(spark, [3.0]), {"s": "x"}).first().s == 0


def test_flags_of_missing_values(spark):
    df = column(spark, [1.0, 2.0, 3.0, None])
    got = [r.f for r in stats.add_quantile_flags(df, {"f": ("x", 0.9)}).collect()]
    assert got == [0, 0, 1, 0]


def test_zero_ranges(spark):
    same = column(spark, [2.0, 2.0])
    assert [r.u for r in stats.add_unit_range(same, {"u": "x"}).collect()] == [0.0, 0.0]
    assert [r.x for r in stats.robust_scale(same, ["x"]).collect()] == [0.0, 0.0]
    scaler = stats.Scaler.fit(same, ["x"])
    assert scaler.scale["x"] == 1.0
    assert [r.x for r in scaler.transform(same).collect()] == [0.0, 0.0]


def test_scaler_uses_population_deviation(spark):
    df = column(spark, [1.0, 2.0, 3.0, 4.0])
    assert stats.Scaler.fit(df, ["x"]).scale["x"] == pytest.approx(np.std([1, 2, 3, 4]))
    loaded = stats.Scaler.from_table(stats.Scaler.fit(df, ["x"]).table(spark))
    assert loaded == stats.Scaler.fit(df, ["x"])


def test_medians_fill_gaps(spark):
    df = column(spark, [1.0, None, 5.0, 3.0])
    assert sorted(r.x for r in stats.impute_medians(df, ["x"]).collect()) == [1.0, 3.0, 3.0, 5.0]


@pytest.mark.parametrize("kind", ["low", "high", "ends", "wide", "only"])
def test_infinities_and_wide_ranges_as_the_built_in_aggregate(spark, kind):
    inf, many = float("inf"), [float(i) for i in range(37)]
    values = {
        "low": [-inf] * 5 + many,
        "high": many + [inf] * 5,
        "ends": [-inf, *many, inf],
        "wide": [-1.7e308, 1.7e308],
        "only": [-inf, 4.0],
    }[kind]
    at = [0.0, 0.03, 0.1, 0.13, 0.5, 0.77, 0.95, 1.0]
    df = column(spark, values)
    built_in = df.selectExpr(f"percentile(x, array({', '.join(map(str, at))})) as q").first().q
    got = stats.quantiles(df, {"x": at})["x"]
    assert not any(np.isnan(v) for v in got.values())
    assert list(got.values()) == pytest.approx(built_in, rel=1e-12)
