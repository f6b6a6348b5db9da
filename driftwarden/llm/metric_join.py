"""Embedding near-duplicates by an exact metric range join.

Vectors with equal labels whose cosine reaches the threshold are within a fixed
distance of each other on the unit sphere. Pivots part the vectors of a label: each has
its home in the cell of the nearest pivot, and is also a guest of every cell that the
triangle inequality (and the sharper distance to the plane between two pivots) cannot
exclude. All neighbours of a vector are then present in its home cell, so cells are
joined independently and each link is counted where the vector is at home.

Cells pay where vectors cluster. If P pivots leave a vector in g cells on average, each of
its copies meets a P-th of the g-fold vectors, so cells cost g^2 / P of what one cell
would. Labels where that is not below 1, as for vectors that are spread evenly over many
dimensions, keep one cell, which is joined in blocks.

Equal vectors are joined once, as a class with a multiplicity. Cells are cut into pairs
of blocks, so no task holds a large one. A task returns a number of links for each
vector and a spanning forest, never the links themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, components, map_batches, store

CELL = 4096  # classes that a cell is meant to hold
PIVOTS = 2048  # in all; they travel with the tasks
BLOCK = 4096  # classes on either side of a task
SLACK = 1e-6  # for rounding in distances


def near_cells(vectors: np.ndarray, centres: np.ndarray, reach: float, own: bool = False):
    """For unit vectors (rows) the nearest of the pivots, and which cells the triangle
    inequality leaves them in. With ``own`` the vectors are the pivots, each without itself."""
    squares = np.maximum(2 - 2 * vectors @ centres.T, 0)
    if own:
        np.fill_diagonal(squares, np.inf)
    far = np.sqrt(squares)
    home = np.argmin(far, axis=1)
    rows = np.arange(len(vectors))
    nearest = far[rows, home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * centres[home] @ centres.T, 0))
    near = (far - nearest <= 2 * reach + SLACK) & (squares - nearest**2 <= 2 * reach * apart + SLACK)
    near[rows, home] = True
    return home, near


def _assign(pivots: dict[tuple[int, int], np.ndarray], reach: float):
    def run(batch: pa.RecordBatch) -> dict:
        homes: list = [0] * len(batch)
        cells: list = [[0]] * len(batch)
        groups: dict[tuple[int, int], list[int]] = {}
        vectors = [v.values.to_numpy().astype(float) for v in batch.column("vector")]
        for row, (label, v) in enumerate(zip(batch.column("label").to_pylist(), vectors)):
            if (label, len(v)) in pivots:
                groups.setdefault((label, len(v)), []).append(row)
        for key, rows in groups.items():
            found = np.stack([vectors[r] for r in rows])
            found /= np.sqrt((found * found).sum(axis=1, keepdims=True))
            for row, home, near in zip(rows, *near_cells(found, pivots[key], reach)):
                homes[row], cells[row] = int(home), np.flatnonzero(near)
        return {c: batch.column(c) for c in ("node", "label", "vector", "copies")} | {"home": homes, "cells": cells}

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows have a cosine, in double precision, that reaches the threshold."""
    norms = np.outer(np.sqrt((left * left).sum(1)), np.sqrt((right * right).sum(1)))
    return left @ right.T / norms >= threshold


class Forest:
    """Roots of nodes 0..n-1 under unions that come as arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            # Each larger root moves below the smallest root it meets.
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _join(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        node, copies, vectors = table["node"].to_numpy(), table["copies"].to_numpy(), _matrix(table["vector"])
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = np.zeros(len(own), np.int64)
        nodes, place = np.unique(node, return_inverse=True)
        forest = Forest(len(nodes))
        for at in range(0, len(own), 512):
            rows = own[at : at + 512]
            hit = linked(vectors[rows], vectors[other], threshold)
            hit &= node[rows][:, None] != node[other]
            found[at : at + 512] = hit @ copies[other]
            i, j = np.nonzero(hit)
            forest.unite(place[rows[i]], place[other[j]])
        roots = nodes[forest.root[place[own]]]
        rest = other[nodes[forest.root[place[other]]] != node[other]]
        return pa.table({
            "node": pa.array(np.concatenate([node[own], node[rest]]), pa.int64()),
            "links": pa.array(np.concatenate([found, np.zeros(len(rest), np.int64)]), pa.int64()),
            "root": pa.array(np.concatenate([roots, nodes[forest.root[place[rest]]]]), pa.int64()),
        })

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links (other
    vectors linked directly), component_id (smallest vec_id reachable, itself included),
    kept (vec_id = component_id).

    Vectors link if their labels are equal and not null, their lengths are equal and
    their cosine reaches the threshold. Null, zero and empty vectors, and those with
    null, NaN or infinite components, link with nothing; so do rows without vec_id,
    whose component_id is null and who are kept. Repeated rows count as vectors.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usable = F.expr(
        "vec_id is not null and label is not null and size(embedding) > 0 "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(embedding, x -> x <> 0)"
    )
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.when(usable, F.col("embedding").cast("array<double>")).alias("vector"),
    )
    classes = store(
        rows.where("vector is not null").groupBy("label", "vector")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")),
        "vector-classes",
    )
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    pivots = {k: c for k, c in _pivots(classes).items() if worth(c, reach)}
    placed = store(
        map_batches(
            classes, _assign(pivots, reach),
            "node long, label long, vector array<double>, copies long, home int, cells array<int>",
        ),
        "vector-cells",
    )
    spread = placed.selectExpr(
        "node", "label", "size(vector) as length", "vector", "copies", "home", "explode(cells) as cell"
    )
    keys = ["label", "length", "cell"]
    sizes = spread.groupBy(keys).agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    dealt = spread.join(sizes, keys).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    shown = ["node", "vector", "copies"]
    sides = dealt.where("home = cell").selectExpr(
        *keys, "block as low", "explode(sequence(0, blocks - 1)) as high", "0 as side", *shown
    ).union(
        dealt.selectExpr(*keys, "explode(sequence(0, blocks - 1)) as low", "block as high", "1 as side", *shown)
    )
    joined = store(
        sides.groupBy(*keys, "low", "high").applyInArrow(_join(threshold), "node long, links long, root long"),
        "vector-links",
    )
    links = joined.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(joined.where("node <> root").selectExpr("node as a", "root as b"))
    return (
        rows.join(classes.select("label", "vector", "node", "copies"), ["label", "vector"], "left")
        .join(links, "node", "left").join(labels, "node", "left")
        .selectExpr(
            "vec_id",
            "coalesce(copies - 1 + coalesce(links, 0), 0) as n_links",
            "coalesce(component, node, vec_id) as component_id",
            "coalesce(vec_id = coalesce(component, node, vec_id), true) as kept",
        )
    )


def worth(centres: np.ndarray, reach: float) -> bool:
    """Do cells cost less than one cell would, by how many cells each pivot is near?"""
    if len(centres) < 3:
        return False
    _, near = near_cells(centres, centres, reach, own=True)
    return (near.sum(axis=1).mean()) ** 2 < len(centres)


def _pivots(classes: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Unit vectors, at most about ``PIVOTS`` in all, of labels with more classes than a
    cell is meant to hold: a share of their classes drawn by hash."""
    sized = classes.select("label", F.size("vector").alias("length"), "node", "vector")
    counts = sized.groupBy("label", "length").count()
    large = counts.where(F.col("count") > CELL).orderBy(F.desc("count"), "label", "length").limit(PIVOTS // 2)
    total = large.agg(F.sum("count")).first()[0]
    if not total:
        return {}
    share = min(PIVOTS, 2 * total / CELL) / total
    drawn = sized.join(F.broadcast(large.drop("count")), ["label", "length"]).where(
        F.pmod(F.xxhash64("node", F.lit(3)), F.lit(10_000_019)) < int(share * 10_000_019)
    )
    found: dict[tuple[int, int], list] = {}
    for r in drawn.orderBy("label", "length", "node").collect():
        v = np.array(r.vector, float)
        found.setdefault((r.label, r.length), []).append(v / np.sqrt(v @ v))
    return {k: np.array(v) for k, v in found.items()}
