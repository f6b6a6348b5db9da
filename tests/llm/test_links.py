"""Near duplicates and vector links against brute force."""

import math
import re

import numpy as np
import pytest

import cases
from driftwarden.llm import metric_join, minhash_dedup
from driftwarden.llm.common import components


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def sets(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    found = {i: sets(t) for i, t in rows.items()}
    ids = sorted(found)
    links = [
        (a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]
        if found[a] and 100 * len(found[a] & found[b]) >= 85 * len(found[a] | found[b])
    ]
    comp = groups(ids, links)
    return {i: (len(found[i]), comp[i], comp[i] == i) for i in ids}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = cases.texts() | {r["doc_id"] + 1000: r["text"] for r in cases.table("documents")}
    got = minhash_dedup.near_duplicates(cases.documents(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows)


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string"
    )
    got = sorted(map(tuple, minhash_dedup.near_duplicates(docs).collect()), key=str)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert minhash_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_sketches_estimate_similarity():
    draw = np.random.default_rng(1)
    k = minhash_dedup.BANDS * minhash_dedup.ROWS
    a = draw.integers(0, 2**63, k, dtype=np.uint64)
    b = a.copy()
    b[: k // 10] += np.uint64(1)
    apart = np.bitwise_count(minhash_dedup.odd_sketch(a) ^ minhash_dedup.odd_sketch(b)).sum()
    assert abs(int(apart) - minhash_dedup.bits_apart(0.9)) < 25
    assert minhash_dedup.bits_apart(1.0) == 0


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors():
    draw = np.random.default_rng(3)
    rows, near = [], draw.normal(size=(6, 8))
    for i in range(90):
        v = near[i % 6] + draw.normal(size=8) * (0.15 if i % 3 else 1)
        rows.append((i, [float(x) for x in np.float32(v)], i % 3))
    rows += [(200, rows[3][1], 0), (201, rows[3][1], 0), (202, rows[3][1], None)]
    rows += [(203, None, 0), (204, [0.0] * 8, 0), (205, [], 0), (206, [1.0, None] + [0.0] * 6, 0)]
    rows += [(207, [math.nan] + [1.0] * 7, 0), (208, [math.inf] * 8, 0), (209, [1.0, 2.0], 0), (210, [2.0, 4.0], 0)]
    return rows


def brute_vectors(rows, threshold):
    ok = {
        i: (np.array(v, float), label) for i, v, label in rows
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    links = [
        (a, b) for a in ok for b in ok
        if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0])
        and ok[a][0] @ ok[b][0] / np.sqrt((ok[a][0] @ ok[a][0]) * (ok[b][0] @ ok[b][0])) >= threshold
    ]
    comp = groups([r[0] for r in rows], links)
    return {i: (sum(i in x for x in links), comp[i], comp[i] == i) for i in comp}


def test_cells_are_kept_where_vectors_cluster():
    draw = np.random.default_rng(5)
    spread = draw.normal(size=(500, 64))
    around = np.repeat(draw.normal(size=(100, 64)), 5, axis=0) + 0.05 * draw.normal(size=(500, 64))
    reach = math.sqrt(2 - 2 * 0.93)
    unit = [v / np.linalg.norm(v, axis=1, keepdims=True) for v in (spread, around)]
    assert [metric_join.worth(v, reach) for v in unit] == [False, True]
    home, near = metric_join.near_cells(unit[1], unit[1][::5], reach)
    assert (home == np.arange(500) // 5).all() and near[np.arange(500), home].all() and near.sum() < 2500
    close = (unit[1] @ unit[1].T) >= 0.93
    assert all(near[j, home[i]] for i, j in zip(*np.nonzero(close)))


@pytest.mark.parametrize("cell,worth", [(4096, None), (8, None), (8, True)])
def test_vector_links_match_brute_force(spark, monkeypatch, cell, worth):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "BLOCK", cell)
    if worth is not None:
        monkeypatch.setattr(metric_join, "worth", lambda centres, reach: worth)
    rows = vectors()
    frame = spark.createDataFrame(
        [(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, copies string"
    )
    got = metric_join.near_vectors(frame).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute_vectors(rows, 0.93)
    assert metric_join.near_vectors(frame.limit(0)).collect() == []
