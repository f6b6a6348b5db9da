"""MinHash near-duplicates with odd sketches.

Every text becomes the set of its distinct word shingles. Equal sets are one class.
Class representatives get MinHash samples, whose bands name candidate buckets, and an
odd sketch: every sample toggles one bit of a small bitmap, so that the population
count of the XOR of two bitmaps estimates high similarities precisely. Candidates that
pass the estimate are confirmed on full sets, and links make connected components.

No bucket is expanded into all pairs. Its members are first compared with its smallest
one. Only buckets that still hold several components go on: members whose shingles
shared with any other remaining text cannot reach the threshold leave, and the rest is
compared across components only, bitmap against bitmap inside tasks, large buckets cut
into blocks. What passes the estimate is confirmed like before.

Bands and slack are set such that a pair at the threshold is missed with a probability
of about one in a hundred thousand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .common import bounded_batches, components, map_batches, store

SHINGLE = 5
BANDS, ROWS = 36, 8
BITS = 512
SLACK = 0.12  # more than five standard deviations of the estimate at the threshold
BLOCK = 2048  # members of a bucket that one task compares

_PROFILE = (
    "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>"
)


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    return np.unique(hashing.shingles(words, size))


def samples(values: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One minimum per hash function over the set."""
    best = np.full(len(factors), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 128):
            part = (values[at : at + 128, None] ^ offsets) * factors
            np.minimum(best, part.min(axis=0), out=best)
    return best


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples as 64-bit words."""
    place = np.arange(len(minima), dtype=np.uint64)
    with np.errstate(over="ignore"):
        bit = hashing.mix(minima + place * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)
    parity = np.bincount(bit.astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def bits_apart(similarity: float, k: int = BANDS * ROWS) -> int:
    """The expected number of bits in which two sketches of that similarity differ."""
    return int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * k * (1 - max(0.0, similarity)))))


def _profile(batch: pa.RecordBatch) -> dict:
    k = BANDS * ROWS
    factors, offsets = hashing.multipliers(k, 101), hashing.multipliers(k, 202)
    texts = batch.column("text")
    out: dict[str, list] = {"n_shingles": [], "f1": [], "f2": [], "bands": [], "sketch": []}
    weights = hashing.multipliers(ROWS, 303)
    for begin, end in hashing.chunks(texts):
        words, at = hashing.word_hashes(texts.slice(begin, end - begin))
        for i in range(end - begin):
            values = shingle_set(words[at[i] : at[i + 1]])
            out["n_shingles"].append(len(values))
            with np.errstate(over="ignore"):
                first = np.bitwise_xor.reduce(values, initial=np.uint64(0))
                second = hashing.mix(values ^ offsets[0]).sum(dtype=np.uint64)
            out["f1"].append(first.view(np.int64))
            out["f2"].append(second.view(np.int64))
            if not len(values):
                out["bands"].append(None)
                out["sketch"].append(None)
                continue
            minima = samples(values, factors, offsets)
            with np.errstate(over="ignore"):
                rows = (hashing.mix(minima).reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64)
                keys = hashing.mix(rows + np.arange(BANDS, dtype=np.uint64) * factors[1])
            out["bands"].append(keys.view(np.int64))
            out["sketch"].append(odd_sketch(minima).view(np.int64))
    return {"doc_id": batch.column("doc_id"), **out}


def _sets(batch: pa.RecordBatch) -> dict:
    texts = batch.column("text")
    values = []
    for begin, end in hashing.chunks(texts):
        words, at = hashing.word_hashes(texts.slice(begin, end - begin))
        values += [
            shingle_set(words[at[i] : at[i + 1]]).view(np.int64) for i in range(end - begin)
        ]
    return {"node": batch.column("node"), "shingles": values}


def _similar(percent: int):
    def check(batch: pa.RecordBatch) -> dict:
        keep, left = [], None
        a, sa, sb = batch.column("a").to_numpy(), batch.column("sa"), batch.column("sb")
        for i in range(batch.num_rows):
            if not i or a[i] != a[i - 1]:
                left = sa[i].values.to_numpy()
            right = sb[i].values.to_numpy()
            common = len(np.intersect1d(left, right, assume_unique=True))
            keep.append(100 * common >= percent * (len(left) + len(right) - common))
        return {"a": batch.column("a"), "b": batch.column("b"), "linked": keep}

    return check


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    right = sets.selectExpr("node as b", "shingles as sb")
    left = sets.selectExpr("node as a", "shingles as sa")
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "sa", "sb")
    return map_batches(both, _similar(percent), "a long, b long, linked boolean").where(
        "linked"
    ).select("a", "b")


def _across(limit: int, percent: int):
    """Pairs of different components in a bucket that may reach the threshold. A pair
    that shares several buckets comes from the first of its bands only."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, comp, n, shared, block = (
            table[c].to_numpy() for c in ("node", "component", "n_shingles", "shared", "block")
        )
        sketch = np.array(table["sketch"].to_pylist(), np.int64).view(np.uint64)
        sketch = sketch.reshape(len(node), BITS // 64)
        bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(node), BANDS)
        bucket = key[0].as_py()
        crossing = key[1].as_py() != key[2].as_py()
        found = []
        for begin in range(0, len(node), 256):
            rows = slice(begin, min(begin + 256, len(node)))
            fit = (node[rows, None] < node) & (comp[rows, None] != comp)
            if crossing:
                fit &= block[rows, None] != block
            low, high = np.minimum(n[rows, None], n), np.maximum(n[rows, None], n)
            fit &= 100 * low >= percent * high
            fit &= (100 + percent) * np.minimum(shared[rows, None], shared) >= percent * (low + high)
            i, j = np.nonzero(fit)
            i += begin
            apart = np.zeros(len(i), np.int64)
            for word in range(BITS // 64):
                apart += np.bitwise_count(sketch[i, word] ^ sketch[j, word])
            i, j = i[apart <= limit], j[apart <= limit]
            first = np.argmax(bands[i] == bands[j], axis=1)
            i, j = i[bands[i, first] == bucket], j[bands[i, first] == bucket]
            found.append(np.stack([node[i], node[j]]))
        pairs = np.concatenate(found, axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Components of texts with 100 * |common shingles| >= percent * |union|.

    ``docs`` has ``doc_id`` (whole number) and ``text``; other columns are ignored.
    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (smallest
    doc_id reachable, itself included), kept (doc_id = component_id). Null and empty
    texts have no shingles and link with nothing. Rows without doc_id are not linked;
    their component_id is null and they are kept. Equal texts link; rows that share a
    doc_id belong to one component.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    base = store(map_batches(docs, _profile, _PROFILE), "minhash-profiles")
    classes = store(
        base.where("n_shingles > 0 and doc_id is not null")
        .groupBy("f1", "f2", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "minhash-classes",
    )
    rows = classes.selectExpr("node", "explode(bands) as bucket")
    leaders = (
        rows.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("top"))
        .where("a < top").select("bucket", "a")
    )
    members = store(rows.join(leaders, "bucket").select("bucket", "node", "a"), "minhash-buckets")
    nodes = members.select("node").distinct()
    marks = store(
        classes.join(nodes, "node").select("node", "n_shingles", "sketch", "bands"), "minhash-marks"
    )
    texts = docs.join(marks.select(F.col("node").alias("doc_id")).distinct(), "doc_id")
    sets = store(
        map_batches(texts.selectExpr("doc_id as node", "text"), _sets, "node long, shingles array<long>"),
        "minhash-sets",
    )
    limit = bits_apart(percent / 100 - SLACK)

    stars = members.where("node > a").selectExpr("a", "node as b").distinct()
    left = marks.selectExpr("node as a", "n_shingles as na", "sketch as ka")
    right = marks.selectExpr("node as b", "n_shingles as nb", "sketch as kb")
    close = stars.join(right, "b").join(left, "a").where(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb) and "
        f"aggregate(zip_with(ka, kb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) <= {limit}"
    )
    first = store(confirmed(close, sets, percent), "minhash-links")
    labels = store(components(first), "minhash-labels")

    rest = members.select("bucket", "node").join(labels, "node", "left").selectExpr(
        "bucket", "node", "coalesce(component, node) as component"
    )
    rest = store(_several(rest), "minhash-rest")
    owners = (
        sets.join(rest.select("node").distinct(), "node")
        .selectExpr("node", "explode(shingles) as shingle")
        .groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("top"))
        .where("node = top").groupBy("node").agg(F.count("*").alias("own"))
    )
    able = marks.join(owners, "node", "left").selectExpr(
        "node", "n_shingles", "sketch", "bands", "n_shingles - coalesce(own, 0) as shared"
    ).where(f"100 * shared >= {percent} * n_shingles")
    rest = _several(rest.join(able.select("node"), "node"))
    sizes = rest.groupBy("bucket").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    dealt = (
        rest.join(sizes, "bucket").join(able, "node")
        .withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
        .withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
        .selectExpr("bucket", "least(block, other) as low", "greatest(block, other) as high",
                    "node", "component", "n_shingles", "shared", "sketch", "bands", "block")
    )
    crossing = dealt.groupBy("bucket", "low", "high").applyInArrow(
        _across(limit, percent), "a long, b long"
    )
    second = store(confirmed(store(crossing, "minhash-cross"), sets, percent), "minhash-links")
    final = components(
        labels.selectExpr("node as a", "component as b").union(second)
    ).union(labels.where("node = component").select("node", "component"))
    final = final.groupBy("node").agg(F.min("component").alias("component"))

    named = base.join(
        classes.select("f1", "f2", "n_shingles", "node"), ["f1", "f2", "n_shingles"], "left"
    ).join(final, "node", "left")
    return named.selectExpr(
        "doc_id",
        "n_shingles",
        "case when doc_id is not null then coalesce(component, node, doc_id) end as component_id",
        "coalesce(doc_id = coalesce(component, node, doc_id), true) as kept",
    )


def _several(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component."""
    mixed = (
        rows.groupBy("bucket").agg(F.min("component").alias("l"), F.max("component").alias("h"))
        .where("l < h").select("bucket")
    )
    return rows.join(mixed, "bucket")
