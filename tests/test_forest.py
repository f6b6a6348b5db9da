"""The forest against plain path lengths, and its properties."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

from driftwarden.operators import forest
from driftwarden.session import materialize, scratch_path
from driftwarden.sources.versions import publish, published


def frame(spark, data):
    rows = [(f"u{i:05d}", *map(float, row)) for i, row in enumerate(data)]
    names = ", ".join(f"f{j} double" for j in range(data.shape[1]))
    return spark.createDataFrame(rows, f"user string, {names}")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    cloud = rng.normal(size=(400, 3))
    return np.vstack([cloud, [[9.0, 9.0, -9.0], [-8.0, 10.0, 9.0]]])


@pytest.fixture(scope="module")
def fitted(spark, data):
    df = materialize(frame(spark, data))
    return df, forest.IsolationForest.fit(df, ["f0", "f1", "f2"], trees=40)


def brute_score(model, row):
    """Follow one row down every tree, node by node."""
    lengths = []
    for _, tree in model.nodes.groupby("tree_id"):
        nodes = {n.node_id: n for n in tree.itertuples()}
        node = nodes[1]
        while node.feature >= 0:
            node = nodes[node.left_id if row[node.feature] <= node.threshold else node.right_id]
        lengths.append(node.depth + float(forest.mean_path(node.size)))
    return -(2.0 ** (-np.mean(lengths) / float(forest.mean_path(model.sample))))


def test_scores_equal_brute_force(fitted, data):
    df, model = fitted
    got = {r.user: r.s for r in df.select("user", model.score().alias("s")).collect()}
    for i in (0, 7, 200, 400, 401):
        assert got[f"u{i:05d}"] == pytest.approx(brute_score(model, data[i]), abs=1e-12)


def test_joins_and_batches_score_alike(fitted):
    df, model = fitted
    batches = {r.user: r.s for r in df.select("user", model.score().alias("s")).collect()}
    joins = {r.user: r.score for r in forest.score_by_joins(df, model).collect()}
    assert joins == pytest.approx(batches, abs=2e-12)
    plan = forest.score_by_joins(df, model)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Python" not in plan


def test_a_choice_is_a_function_of_its_name(spark):
    names = [(1, 2, 3, "cut"), (42, 0, 511, "feature"), ("ab", 7)]
    for name in names:
        parts = [f"'{p}'" if isinstance(p, str) else str(p) for p in name]
        assert spark.sql(f"select {forest.uniform_sql(*parts)}").first()[0] == forest.uniform(*name)


def test_outliers_come_first_and_share_is_near_contamination(fitted):
    df, model = fitted
    rows = df.select("user", model.decision().alias("d")).orderBy("d").collect()
    assert {rows[0].user, rows[1].user} == {"u00400", "u00401"}
    assert sum(r.d < 0 for r in rows) == pytest.approx(0.05 * len(rows), abs=2)


def test_partitioning_does_not_change_the_forest(fitted):
    df, model = fitted
    again = forest.IsolationForest.fit(df.repartition(7), ["f0", "f1", "f2"], trees=40)
    order = ["tree_id", "node_id"]
    left = model.nodes.sort_values(order, ignore_index=True)
    assert left.equals(again.nodes.sort_values(order, ignore_index=True))
    assert model.offset == again.offset


@pytest.mark.parametrize("trees", [100, 20])
def test_samples_follow_one_law(spark, trees):
    df = materialize(spark.range(6000).selectExpr("cast(id as string) as user", "rand(1) as f0"))
    drawn = forest.draw_samples(df, ["f0"], 6000, trees, 64, 1).groupBy("tree_id").count().collect()
    sizes = [r["count"] for r in drawn]
    assert len(sizes) == trees and max(sizes) <= 64 and np.mean(sizes) > 62 and min(sizes) >= 48


def test_rows_without_a_user_are_drawn_apart(spark):
    df = spark.range(6000).selectExpr("if(id < 4000, null, cast(id as string)) as user", "rand(1) as f0")
    drawn = forest.draw_samples(materialize(df), ["f0"], 6000, 50, 64, 1)
    shares = drawn.groupBy("tree_id").agg({"*": "count", "row_key": "count"}).collect()
    assert len(shares) == 50
    assert sum(r["count(row_key)"] for r in shares) / sum(r["count(1)"] for r in shares) == pytest.approx(1 / 3, abs=0.05)


def test_model_survives_storage(spark, fitted):
    df, _ = fitted
    model = forest.AnomalyModel.fit(df, ["f0", "f1", "f2"], trees=15)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    loaded = forest.AnomalyModel.load(spark, path)
    before = {r.user: r.iforest_raw_score for r in model.decide(df).collect()}
    after = {r.user: r.iforest_raw_score for r in loaded.decide(df).collect()}
    assert before == after


def test_a_broken_off_write_leaves_the_version_before(spark, fitted, monkeypatch):
    df, _ = fitted
    path = scratch_path(spark, "model")
    with pytest.raises(ValueError):
        published(spark, path)
    first = forest.AnomalyModel.fit(df, ["f0", "f1"], trees=3)
    first.save(spark, path)
    second = forest.AnomalyModel.fit(df, ["f0", "f1", "f2"], trees=4)

    def broken(self, *args, **kwargs):
        if "nodes" in args[0]:
            raise OSError("gone")
        return write(self, *args, **kwargs)

    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        second.save(spark, path)
    monkeypatch.undo()
    assert forest.AnomalyModel.load(spark, path).forest.columns == ("f0", "f1")
    second.save(spark, path)
    loaded = forest.AnomalyModel.load(spark, path)
    assert loaded.forest.columns == ("f0", "f1", "f2") and loaded.forest.nodes.tree_id.nunique() == 4


def test_a_version_that_lost_rows_is_refused(spark):
    path = scratch_path(spark, "version")
    folder = publish(spark, path, {"one": spark.range(3)})
    spark.range(1).write.mode("append").parquet(f"{folder}/one")
    with pytest.raises(ValueError):
        published(spark, path)


def test_identical_rows(spark):
    df = frame(spark, np.ones((20, 2)))
    model = forest.IsolationForest.fit(df, ["f0", "f1"], trees=5)
    assert len({r[0] for r in df.select(model.score()).collect()}) == 1
