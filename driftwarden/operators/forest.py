"""Isolation forest as Spark jobs (MDL-1..7, SNK-6, SRC-4).

Liu, Ting and Zhou, "Isolation Forest", ICDM 2008. Spark draws one small sample
per tree by hashing user ids, grows the trees in parallel, one group of at most
256 rows each, and scores users in Arrow batches, or by joins, against the node table,
whose size is bounded by trees x (2 x sample - 1) whatever the population.

Every random choice is a number made from the MD5 digest of what it is for (the user, the
tree, the node, the seed), so that any engine can repeat it: a forest follows from its
rows and its seed alone.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import col, either, number, round_half_even, with_expressions
from ..session import materialize
from ..sources.versions import publish, published
from .statistics import Scaler, quantiles, summarize, unit_range

NODE_SCHEMA = (
    "tree_id int, node_id int, feature int, threshold double, "
    "left_id int, right_id int, size int, depth int"
)
_OVERDRAW = 1.3
_DIGITS = 13  # hexadecimal; a double holds them exactly
# Scores are rounded so far that the order of additions does not show: equal rows have
# equal scores on either road, and whoever is at the offset stays there.
_SCORE_DIGITS = 12

# The two batch functions travel to the workers with the job, so executors need
# numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mean_path(size: np.ndarray | int) -> np.ndarray:
    """Average path length of an unsuccessful search among ``size`` rows."""
    n = np.asarray(size, dtype=float)
    big = np.maximum(n, 3.0)
    harmonic = np.log(big - 1.0) + np.euler_gamma
    return np.where(n > 2, 2.0 * harmonic - 2.0 * (big - 1.0) / big, np.where(n == 2, 1.0, 0.0))


def uniform(*parts: object) -> float:
    """A number in (0, 1) from the digest of ``parts``."""
    digest = hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()
    return (int(digest[:_DIGITS], 16) + 0.5) / 16.0**_DIGITS


def uniform_sql(*parts: str) -> str:
    """``uniform`` as an expression."""
    digest = f"md5(concat_ws(':', {', '.join(parts)}))"
    return f"((cast(conv(substr({digest}, 1, {_DIGITS}), 16, 10) as double) + 0.5D) / {16.0**_DIGITS!r}D)"


def grow_tree(rows: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Random splits down to single rows, equal rows, or the depth limit. Node 1 is the
    root, and node i has the children 2 i and 2 i + 1."""
    limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[tuple] = []
    pending = [(1, rows, 0)]
    while pending:
        node, part, depth = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth == limit or varying.size == 0:
            nodes.append((node, -1, 0.0, -1, -1, len(part), depth))
            continue
        place = int(uniform(seed, tree, node, "feature") * varying.size)
        feature = int(varying[min(place, varying.size - 1)])
        threshold = float(low[feature] + uniform(seed, tree, node, "cut") * (high[feature] - low[feature]))
        if not threshold < high[feature]:
            threshold = float(low[feature])  # rounding put the cut on the highest value
        left = part[:, feature] <= threshold
        nodes.append((node, feature, threshold, 2 * node, 2 * node + 1, len(part), depth))
        pending.append((2 * node, part[left], depth + 1))
        pending.append((2 * node + 1, part[~left], depth + 1))
    return nodes


def draw_samples(
    df: DataFrame, columns: Sequence[str], rows: int, trees: int, sample: int, seed: int
) -> DataFrame:
    """At most ``sample`` rows per tree, chosen by the digest of the user id, or of the
    features for rows without one.

    Every row enters every tree with the same chance, independently, at any size of the
    population; neither partitioning nor order matters. One number per row gives the
    first tree that takes it, by the law of waiting times; most rows of a large population
    find none and are gone. Only the others are tried against the trees after that.
    """
    share = min(_OVERDRAW * sample / rows, 1.0)
    key = "cast(`user` as string)"
    content = f"md5(coalesce({key}, cast(xxhash64({', '.join(map(col, columns))}) as string)))"
    if share < 1:
        first = f"floor(ln({uniform_sql('row_hash', str(seed))}) / {number(math.log1p(-share))})"
    else:
        first = "0"
    picked = f"{uniform_sql('row_hash', 'tree', str(seed))} < {number(share)}"
    taken = (
        df.selectExpr(
            f"{content} as row_hash",
            f"{key} as row_key",
            *[f"cast({col(c)} as double) as {col(c)}" for c in columns],
        )
        .withColumn("first_tree", F.expr(first))
        .where(F.col("first_tree") < trees)
        .withColumn(
            "tree_id",
            F.expr(
                f"explode(filter(sequence(cast(first_tree as int), {trees - 1}), "
                f"tree -> tree = first_tree or {picked}))"
            ),
        )
        .drop("first_tree")
    )
    order = Window.partitionBy("tree_id").orderBy(
        F.expr(f"md5(concat_ws(':', row_hash, tree_id, {seed}, 'order'))"), "row_key", *map(col, columns)
    )
    return (
        taken.withColumn("draw", F.row_number().over(order))
        .where(F.col("draw") <= sample)
        .drop("draw", "row_hash")
    )


@dataclass(frozen=True)
class IsolationForest:
    """A fitted forest: node table, tree sample size, and decision offset."""

    columns: tuple[str, ...]
    nodes: pd.DataFrame
    sample: int
    offset: float

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        columns: Sequence[str],
        trees: int = fixed.PROFILE_TREES,
        contamination: float = fixed.CONTAMINATION,
        seed: int = fixed.MODEL_SEED,
        sample: int = fixed.TREE_SAMPLE,
    ) -> IsolationForest:
        """MDL-1. ``df`` has one row per ``user`` and no NULL features."""
        columns = tuple(columns)
        rows = df.count()
        if rows == 0:
            raise ValueError("cannot fit a forest on no rows")
        nodes = node_table(df, columns, rows, trees, sample, seed).toPandas()  # size-bounded
        forest = cls(columns, nodes, min(sample, rows), 0.0)
        offset = forest._fit_offset(df, contamination)
        return cls(columns, nodes, forest.sample, offset)

    def _fit_offset(self, df: DataFrame, contamination: float) -> float:
        """MDL-4: the score at the contamination quantile."""
        scores = materialize(df.select(self.score().alias("score")))
        return quantiles(scores, {"score": [contamination]})["score"][contamination]

    def score(self) -> Column:
        """Minus the paper's anomaly score: in [-1, 0), lower is more anomalous."""
        walk = _walker(self.nodes, self.sample)
        return F.pandas_udf(walk, "double")(*[F.col(c).cast("double") for c in self.columns])

    def decision(self) -> Column:
        """MDL-2: score relative to the offset; negative means anomalous."""
        return self.score() - F.lit(self.offset)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """SNK-6: nodes, features and settings as tables."""
        settings = [(self.sample, float(self.offset), list(self.columns))]
        return {
            "nodes": spark.createDataFrame(self.nodes, NODE_SCHEMA),
            "settings": spark.createDataFrame(settings, "sample int, offset double, columns array<string>"),
        }

    @classmethod
    def from_tables(cls, tables: dict[str, DataFrame]) -> IsolationForest:
        """SRC-4."""
        settings = tables["settings"].first()
        nodes = tables["nodes"].toPandas()  # size-bounded
        nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
        return cls(tuple(settings["columns"]), nodes, settings["sample"], settings["offset"])


def node_table(
    df: DataFrame,
    columns: Sequence[str],
    rows: int,
    trees: int = fixed.PROFILE_TREES,
    sample: int = fixed.TREE_SAMPLE,
    seed: int = fixed.MODEL_SEED,
) -> DataFrame:
    """One row per node of every tree."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        data = pdf.sort_values(["row_key", *columns])[list(columns)].to_numpy(dtype=float)
        nodes = grow_tree(data, seed, tree)
        out = pd.DataFrame(
            nodes,
            columns=["node_id", "feature", "threshold", "left_id", "right_id", "size", "depth"],
        )
        out.insert(0, "tree_id", tree)
        return out

    samples = draw_samples(df, columns, rows, trees, sample, seed)
    return samples.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)


def _walker(nodes: pd.DataFrame, sample: int):
    """A batch function that sends rows down all trees."""
    nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
    # Node ids become positions in one array over all trees.
    tree = nodes["tree_id"].to_numpy().astype(np.int64) << 32
    ids = tree | nodes["node_id"].to_numpy()
    leaf = nodes["feature"].to_numpy() < 0
    here = np.arange(len(nodes))
    feature = np.where(leaf, 0, nodes["feature"].to_numpy()).astype(np.int32)
    threshold = nodes["threshold"].to_numpy()
    left, right = (
        np.where(leaf, here, np.searchsorted(ids, tree | nodes[c].to_numpy())).astype(np.int32)
        for c in ("left_id", "right_id")
    )
    length = np.where(leaf, nodes["depth"] + mean_path(nodes["size"].to_numpy()), 0.0)
    roots = here[nodes["depth"].to_numpy() == 0].astype(np.int32)
    deepest = int(nodes["depth"].max())
    scale = float(mean_path(sample)) or 1.0

    def walk(*features: pd.Series) -> pd.Series:
        data = np.column_stack([f.to_numpy(dtype=float) for f in features])
        row = np.arange(len(data))
        total = np.zeros(len(data))
        for root in roots:
            at = np.full(len(data), root, dtype=np.int32)
            for _ in range(deepest):
                goes_left = data[row, feature[at]] <= threshold[at]
                at = np.where(goes_left, left[at], right[at])
            total += length[at]
        return pd.Series(np.round(-np.exp2(-total / len(roots) / scale), _SCORE_DIGITS))

    return walk


def score_by_joins(df: DataFrame, forest: IsolationForest) -> DataFrame:
    """MDL-2 without Python: ``user`` and ``score`` of every user of ``df``, which has one
    row each. A row for each user and tree goes down one join per level. The node table is
    bounded, hence broadcast, so users stay where they are until the last sum."""
    spark = df.sparkSession
    internal = "feature >= 0"
    nodes = spark.createDataFrame(forest.nodes, NODE_SCHEMA)
    steps = F.broadcast(nodes.where(internal).selectExpr("tree_id", "node_id", "feature", "threshold"))
    size = "cast(size as double)"
    path = (
        f"case when size > 2 then 2 * (ln({size} - 1) + {float(np.euler_gamma)!r}D) - 2 * ({size} - 1) / {size}"
        " when size = 2 then 1D else 0D end"
    )
    ends = F.broadcast(nodes.where(f"not ({internal})").selectExpr("tree_id", "node_id", f"depth + {path} as length"))
    roots = forest.nodes["tree_id"].unique().tolist()
    values = ", ".join(f"cast({col(c)} as double)" for c in forest.columns)
    at = df.selectExpr(
        "`user`", f"array({values}) as x", f"explode(array({', '.join(map(str, roots))})) as tree_id"
    ).withColumn("node_id", F.lit(1))
    for _ in range(int(forest.nodes["depth"].max())):
        down = "if(feature is null, node_id, 2 * node_id + if(x[feature] <= threshold, 0, 1)) as node_id"
        at = at.join(steps, ["tree_id", "node_id"], "left").selectExpr("`user`", "x", "tree_id", down)
    scale = float(mean_path(forest.sample)) or 1.0
    return at.join(ends, ["tree_id", "node_id"]).groupBy("user").agg(
        F.expr(f"round(-power(2D, -sum(length) / {len(roots)} / {scale!r}D), {_SCORE_DIGITS}) as score")
    )


# --- what is made of the decision score ---------------------------------------


def prediction(decision: str) -> str:
    """MDL-3: -1 for anomalies, 1 otherwise."""
    return either(f"{decision} < 0", "-1", "1")


def suspicion(df: DataFrame, decision: str, output: str) -> DataFrame:
    """MDL-5: reversed min-max of the decision score, 0..100."""
    stats = summarize(df, [decision], ("lo", "hi"))[decision]
    bounds = (None, None) if stats["lo"] is None else (-stats["hi"], -stats["lo"])
    return with_expressions(df, {output: f"{unit_range(f'-{col(decision)}', *bounds)} * 100"})


def rounded_suspicion(df: DataFrame, decision: str, output: str = "anomaly_score") -> DataFrame:
    """MDL-7: the log flow's form, 100 for everyone when all scores are equal."""
    stats = summarize(df, [decision], ("lo", "hi"))[decision]
    if stats["lo"] is None:
        return with_expressions(df, {output: number(None)})
    span = number(float(stats["hi"] - stats["lo"] + 1e-8))
    share = f"({col(decision)} - {number(float(stats['lo']))}) / {span}"
    return with_expressions(df, {output: round_half_even(f"(1 - {share}) * 100", 2)})


def prediction_table(
    df: DataFrame, decision: str = "iforest_raw_score", score: str = "iforest_anomaly_score"
) -> DataFrame:
    """MDL-6: user, prediction, raw and 0..100 score, flag, and label if present."""
    label = ["label as ground_truth_label"] if "label" in df.columns else []
    flag = prediction(col(decision))
    return suspicion(df, decision, score).selectExpr(
        "`user`",
        f"{flag} as iforest_prediction",
        col(decision),
        col(score),
        f"{either(f'{flag} = -1', '1', '0')} as is_anomaly",
        *label,
    )


@dataclass(frozen=True)
class AnomalyModel:
    """Scaler and forest, fitted and stored together."""

    scaler: Scaler
    forest: IsolationForest

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], **settings: object) -> AnomalyModel:
        scaler = Scaler.fit(df, columns)
        # One narrow stored table feeds sampling and the offset.
        scaled = materialize(scaler.transform(df.select("user", *columns)))
        return cls(scaler, IsolationForest.fit(scaled, columns, **settings))

    def decide(self, df: DataFrame, output: str = "iforest_raw_score") -> DataFrame:
        """Add the decision score; only feature columns go to the Python workers."""
        names = {c: f"_scaled_{c}" for c in self.scaler.columns}
        scaled = with_expressions(df, {names[c]: e for c, e in self.scaler.expressions().items()})
        forest = IsolationForest(
            tuple(names[c] for c in self.forest.columns),
            self.forest.nodes,
            self.forest.sample,
            self.forest.offset,
        )
        return scaled.withColumn(output, forest.decision()).drop(*names.values())

    def save(self, spark: SparkSession, path: str) -> str:
        """SNK-6: a new version of the model under ``path``; returns its folder."""
        return publish(spark, path, {"scaler": self.scaler.table(spark), **self.forest.tables(spark)})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnomalyModel:
        """SRC-4: the newest version that was published whole."""
        tables = published(spark, path)
        return cls(Scaler.from_table(tables["scaler"]), IsolationForest.from_tables(tables))
