"""Classifiers, language models and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from driftwarden.llm import hashing, lm_scoring, quality_pu, queries, toxicity_knn


def labelled(name):
    return {r["doc_id"]: r[name] for r in cases.table("labels")}


def test_quality_scores(spark):
    sf = cases.SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op1_quality_pu(spark, sf).collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_the_prior_is_found():
    draw = np.random.default_rng(1)
    positive = draw.normal(2, 1, 4000)
    mixed = np.concatenate([draw.normal(2, 1, 2400), draw.normal(-2, 1, 1600)])
    assert abs(quality_pu.estimate_prior(positive, mixed) - 0.6) < 0.08


def test_the_prior_counts_all_documents(spark, monkeypatch):
    """However few rows the fit draws."""
    seen, ratio = [], quality_pu.smallest_ratio
    monkeypatch.setattr(quality_pu, "smallest_ratio", lambda p, u: seen.append((p[0], u[0])) or ratio(p, u))
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    labels = spark.read.parquet(f"{cases.SF}/labels.parquet")
    assert quality_pu.quality_scores(docs, labels, sample=20).count() == docs.count()
    good = {i for i, q in labelled("quality").items() if q == 1 and zlib.crc32(str(i).encode()) % 5}
    assert seen == [(docs.where(F.col("doc_id").isin(*good)).count(), docs.count())]


def test_nothing_to_learn_from(spark):
    docs = cases.documents(spark, {1: "a b", 2: None})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_pu.quality_scores(docs, none).collect()} == {0.5}
    assert all(0 <= r.score <= 1 and not r.neighbours for r in toxicity_knn.toxicity_scores(docs, none).collect())
    assert quality_pu.quality_scores(docs.limit(0), none).collect() == []
    assert toxicity_knn.toxicity_scores(docs.limit(0), none).collect() == []


def test_toxicity_scores(spark):
    rows = queries.op9_toxicity_knn(spark, cases.SF.replace("0.001", "0.1")).collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(cases.SF.replace("0.001", "0.1") + "/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len(rows) == 10_000
    score, toxic = np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])
    assert (score[toxic == 1] >= 0.3).mean() > 0.75 and (score[toxic == 0] >= 0.3).mean() < 0.04
    for low, high in ((0, 0.1), (0.1, 0.5), (0.5, 1.01)):  # calibrated
        inside = (score >= low) & (score < high)
        assert abs(score[inside].mean() - toxic[inside].mean()) < 0.15


def test_rare_terms_find_an_exact_copy(spark):
    """Words that few examples hold, or both classes use alike, are part of the vectors."""
    shared = [f"common{i}" for i in range(40)]
    rows = {i: " ".join([*shared, f"own{i}", f"only{i}"]) for i in range(200)}
    copies = {1000 + i: rows[i] for i in range(0, 200, 20)}
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in rows], "doc_id long, toxic int")
    drawn = {i for i in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    found = {r.doc_id: r for r in toxicity_knn.toxicity_scores(cases.documents(spark, rows | copies), labels).collect()}
    for i in (i for i in copies if i - 1000 in drawn):
        assert found[i].neighbours[0] == i - 1000 and abs(found[i].similarities[0] - 1) < 1e-5
    sizes = [len(r.neighbours) for r in found.values()]
    assert min(sizes) == toxicity_knn.NEIGHBOURS


def clustered(draw, sizes, own, shared=40):
    """Groups of examples that mostly use terms of their group."""
    found = []
    for group, n in enumerate(sizes):
        for _ in range(n):
            terms = np.concatenate([
                draw.integers(0, shared, 8), shared + group * own + draw.integers(0, own, 30)
            ])
            found.append(np.unique(terms, return_counts=True))
    return found, shared + len(sizes) * own


@pytest.mark.parametrize("frequent", [2048, 64, 0])
def test_neighbours_are_exact_and_blocks_are_skipped(monkeypatch, frequent):
    """Against the cosines of all examples over all terms, whatever blocks hold."""
    monkeypatch.setattr(toxicity_knn, "FREQUENT", frequent)
    monkeypatch.setattr(toxicity_knn, "FIRST", 4)
    draw = np.random.default_rng(2)
    found, size = clustered(draw, [300, 250, 200, 150], 120)
    idf = draw.uniform(1, 3, size)
    ids = draw.permutation(len(found)).tolist()
    index = toxicity_knn.Index(ids, np.arange(len(found)) % 2, found, idf, (1.0, 1.0), 0.1)
    dense = np.zeros((len(found), size))
    for i, x in enumerate(found):
        terms, values = index.vector(*x)
        dense[i, terms] = values
    picked = draw.choice(len(found), 60, replace=False)
    empty = (np.zeros(0, np.int64), np.zeros(0))
    queries = [index.vector(*found[i]) for i in picked] + [empty]
    own = [ids[i] if n % 2 else None for n, i in enumerate(picked)] + [None]
    for (terms, values), mine, got in zip(queries, own, index.nearest(queries, own, k=8)):
        cosine = dict(zip(ids, np.round(dense[:, terms] @ values, 12).tolist()))
        want = sorted((i for i in ids if cosine[i] > 0 and i != mine), key=lambda i: (-cosine[i], i))[:8]
        assert [int(index.ids[place]) for _, place in got] == want
        assert [c for c, _ in got] == pytest.approx([cosine[i] for i in want], abs=1e-5)
    if frequent == 2048:
        assert index.blocks_skipped > index.blocks_scored > 0


def test_ties_fall_to_the_smaller_id():
    found = [np.unique([1, 2, 3], return_counts=True)] * 100
    ids = list(range(500, 400, -1))
    index = toxicity_knn.Index(ids, np.zeros(100), found, np.ones(5), (1.0, 1.0), 0.1)
    (got,) = index.nearest([index.vector(*found[0])], [403], k=4)
    assert index.ids[[place for _, place in got]].tolist() == [401, 402, 404, 405]


def test_the_curve_gives_probabilities():
    draw = np.random.default_rng(3)
    votes = draw.uniform(0, 1, 4000)
    truth = 1 / (1 + np.exp(-(2.5 * toxicity_knn._log_odds(votes) - 1)))
    toxic = (draw.uniform(size=4000) < truth).astype(int)
    slope, offset = toxicity_knn.fitted_curve(votes, toxic, np.ones(4000))
    assert abs(slope - 2.5) < 0.3 and abs(offset + 1) < 0.3
    assert toxicity_knn.fitted_curve(votes, 1 - toxic, np.ones(4000)) == (1.0, 0.0)
    assert toxicity_knn.fitted_curve(votes, np.zeros(4000), np.ones(4000)) == (1.0, 0.0)


def test_no_example_votes_for_itself_and_repeats_are_kept(spark):
    rows = {i: f"aa bb cc dd{i} ee{i}" for i in range(60)}
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in rows], "doc_id long, toxic int")
    docs = cases.documents(spark, rows).union(cases.documents(spark, {5: "another text of five"}))
    docs = docs.union(cases.documents(spark, {5: rows[5], 6: rows[6]}))
    found = toxicity_knn.toxicity_scores(docs, labels).collect()
    assert len(found) == 63 and all(r.doc_id not in r.neighbours for r in found)


def test_language_models(spark):
    good, bad = "the cat sat on the mat " * 5, "zz qq xx vv " * 8
    docs = cases.documents(spark, {1: good, 2: bad, 3: None, 4: "", 5: good + "cat"})
    rows = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs, docs.where("doc_id = 1")).collect()}
    assert rows[5].score < 0 < rows[2].score
    assert (rows[3].n_tokens, rows[3].score, rows[4].score) == (0, 0.0, 0.0)
    assert abs(rows[5].target_loss - rows[5].background_loss - rows[5].score) < 1e-5
    assert {r.score for r in lm_scoring.cross_entropy_difference(docs, docs.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("common", [1 << 20, 1])
def test_language_model_scores_match_brute_force(spark, common):
    """Far more words than classes; with ``common`` 1 every rarer word goes through the join."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(2500)]
    rows = {i: " ".join(draw.choices(words, [1 / (k + 9) for k in range(2500)], k=draw.choice([3, 80, 700]))) for i in range(40)}
    rows |= {50: rows[0], 51: None, 52: ""}
    docs = cases.documents(spark, rows).union(cases.documents(spark, {0: rows[0], 7: "w1 only"}))
    pairs = [*rows.items(), (0, rows[0]), (7, "w1 only")]
    spans = [(i, [w for w in (t or "").split()]) for i, t in pairs]
    trusted = {0, 3, 5, 9}
    every, good = (Counter(w for i, t in spans if i in kept for w in t) for kept in (rows, trusted))
    code = {w: int(hashing.word_hashes(cases.arrow([w]))[0].view(np.int64)[0]) for w in every}
    top = sorted(every, key=lambda w: (-every[w], code[w]))[: lm_scoring.WORDS]
    kind = {w: w if w in set(top) else int(lm_scoring.word_class(np.array([code[w]]).view(np.uint64))[0]) for w in every}
    symbols = [*top, *range(lm_scoring.CLASSES)]

    def model(kept, counts):
        after, both, single, size, within = Counter(), Counter(), Counter(), Counter(kind.values()), Counter()
        for i, t in spans:
            if i in kept:
                for x, y in zip([None, *(kind[w] for w in t)], (kind[w] for w in t)):
                    after[x], both[x, y], single[y] = after[x] + 1, both[x, y] + 1, single[y] + 1
        for w, n in counts.items():
            within[kind[w]] += n
        total = sum(single.values()) + lm_scoring.SMOOTH * len(symbols)

        def loss(x, w):
            y = kind[w]
            p = (single[y] + lm_scoring.SMOOTH) / total
            if after[x]:
                p = lm_scoring.MIX * both[x, y] / after[x] + (1 - lm_scoring.MIX) * p
            if isinstance(y, int):
                p *= (counts[w] + lm_scoring.WITHIN) / (within[y] + lm_scoring.WITHIN * size[y])
            return -math.log(p)

        return loss

    target, background = model(trusted, good), model(rows, every)
    want = sorted(
        (i, *(sum(f(x, w) for x, w in zip([None, *(kind[w] for w in t)], t)) / max(len(t), 1) for f in (target, background)), len(t))
        for i, t in spans
    )
    found = lm_scoring.cross_entropy_difference(docs, docs.where(F.col("doc_id").isin(*trusted)), common).collect()
    got = sorted((r.doc_id, r.target_loss, r.background_loss, r.n_tokens) for r in found)
    assert np.allclose(np.array(got), np.array(want), atol=1e-5)
    assert np.allclose([r.score for r in found], [r.target_loss - r.background_loss for r in found])


def test_word_counts_and_losses(spark):
    rows = cases.texts()
    got = {r.word: r.n for r in lm_scoring.word_counts(cases.documents(spark, rows)).collect()}
    words, _ = hashing.word_hashes(cases.arrow(list(rows.values())), hashing.PUNCTUATION)
    keys, counts = np.unique(words.view(np.int64), return_counts=True)
    assert got == dict(zip(keys.tolist(), counts.tolist()))
    counts = np.random.default_rng(0).integers(0, 5, (6, 6)).astype(float)
    counts[:, 0] = 0
    chance = np.exp(-lm_scoring.losses(counts))
    assert np.allclose(chance.sum(1), 1, atol=1e-5)


def test_pipeline_decides_by_row(spark):
    """Two texts under one doc_id, equal rows, and copies without a doc_id."""
    import corpus_pipeline

    draw = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    one, two, three = (" ".join(draw.choices(words, k=60)) for _ in range(3))
    rows = [(1, one), (1, two), (2, two), (2, two), (None, three), (None, three + " more"), (7, one)]
    kept = "doc_id long, text string"
    near = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, kept), cases.SF)
    left = sorted(((r.doc_id, r.text) for r in near.collect()), key=str)
    texts = [t for _, t in left]
    assert texts.count(one) == texts.count(two) == 1 and len(left) == 3
    assert (2, two) in left or (1, two) in left
    item = spark.read.parquet(f"{cases.SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, item), (1, one), (None, item), (None, two), (3, item)], kept)
    clean = corpus_pipeline.drop_contaminated(spark, docs, cases.SF).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted([(1, one), (None, two)], key=str)
    unique = spark.createDataFrame([(1, one), (2, two)], kept)
    assert [r[corpus_pipeline.KEY] for r in corpus_pipeline.keyed(unique).orderBy("doc_id").collect()] == [1, 2]
    keys = {(r.doc_id, r.text): r[corpus_pipeline.KEY] for r in corpus_pipeline.keyed(docs).collect()}
    assert len(set(keys.values())) == 5 and keys[3, item] == 3 and min(keys.values()) == 1


def test_pipeline_keeps_columns_and_decides(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, cases.SF)
        assert after.columns == docs.columns, name
        assert after.count() <= left.count()
        left = after
    last = corpus_pipeline.run(spark, cases.SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in left.collect()}
    assert 0 < len(last) < docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, cases.SF).count() == 0
