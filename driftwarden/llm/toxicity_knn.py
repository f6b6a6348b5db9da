"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first four and six letters. Labelled examples are a bounded
sample of either class. The vocabulary is every term of theirs, as of a vectoriser
fitted on them, and how many documents hold each term is counted over all documents.

The examples' unit vectors form a block-max inverted index. Similar examples share a
block, and the index keeps the largest weight of each term in each block. A term that few
examples hold has a posting list that is shorter than the list of blocks would be; these
lists are added up first, so their part of a block's bound is its largest true sum. For
the frequent terms the block maxima bound what a block can add. Blocks are scored best
bound first, in rounds, until no bound reaches the k-th best cosine so far; nothing else is
left out, so the neighbours are exact.

A document never votes for itself. Neighbours vote by distance and by how often their
class was sampled, and a logistic curve, fitted on the examples' votes without their own,
turns votes into probabilities. How many neighbours, and their weights, were chosen by
these left-out votes as well, never by labels that are held out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .common import bounded_batches, map_batches, store
from .quality_pu import held_out

EXAMPLES = 3_000  # labelled texts of either class, at most about
NEIGHBOURS = 32
FREQUENT = 2_048  # terms that blocks hold; those of fewer examples have short lists
BLOCK = 64  # examples
FIRST = 8  # blocks of the first round; each later one takes eight times as many
ERROR = 1e-5  # of cosines in single precision; those this near are compared in double
QUERIES = 64  # that meet the index together
THRESHOLD = 0.3
_PREFIXES = (4, 6)


def _all_terms(texts: pa.Array):
    """Pieces ``(hashes, text numbers)``: the words, then each length of first letters."""
    raw, starts, ends, at = hashing.word_spans(texts, hashing.PUNCTUATION)
    words, cuts = hashing.prefix_hashes(raw, starts, ends, _PREFIXES)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    yield words, owner
    for longer, cut in cuts:
        yield cut, owner[longer]


def known_terms(texts: pa.Array, vocabulary: np.ndarray):
    """For each text ``(term numbers, counts)``, of the sorted ``vocabulary`` only."""
    low = np.uint64((1 << 22) - 1)
    maybe = np.zeros(1 << 22, bool)
    maybe[(vocabulary & low).astype(np.int64)] = True
    none = np.zeros(0, np.int64)
    for begin, end in hashing.chunks(texts):
        places, owners = [none], [none]
        for hashes, owner in _all_terms(texts.slice(begin, end - begin)):
            hit = maybe[(hashes & low).astype(np.int64)]
            hashes, owner = hashes[hit], owner[hit]
            if len(hashes):
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[place] == hashes
                places.append(place[known])
                owners.append(owner[known])
        n = max(len(vocabulary), 1)
        pairs, counts = np.unique(np.concatenate(owners) * n + np.concatenate(places), return_counts=True)
        at = np.searchsorted(pairs, np.arange(end - begin + 1) * n)
        for i in range(end - begin):
            yield pairs[at[i] : at[i + 1]] % n, counts[at[i] : at[i + 1]]


def all_terms(texts: pa.Array) -> np.ndarray:
    """The sorted hashes of all terms of ``texts``."""
    found = [np.zeros(0, np.uint64)]
    for begin, end in hashing.chunks(texts):
        found += [np.unique(hashes) for hashes, _ in _all_terms(texts.slice(begin, end - begin))]
    return np.unique(np.concatenate(found))


class Index:
    """Unit vectors of labelled examples in blocks, with the largest weight per term and
    block. The example at ``place`` p is in block p // ``BLOCK``."""

    def __init__(self, ids, toxic, found, idf, weights, prior):
        self.idf, self.prior = idf, prior
        self.weights = weights  # of a clean and of a toxic example's vote
        vectors = [self.vector(*x) for x in found]
        frequency = np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]), minlength=len(idf))
        self.frequent = np.sort(np.argsort(-frequency, kind="stable")[:FREQUENT])
        order = similar_together(vectors, self.frequent, len(idf))
        self.ids = np.array(ids, np.int64)[order]
        self.toxic = np.array(toxic, np.int64)[order]
        empty = np.zeros(0, np.int64)
        self.terms = np.concatenate([empty, *(vectors[i][0] for i in order)]).astype(np.int32)
        self.values = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        self.at = np.cumsum([0, *(len(vectors[i][0]) for i in order)])
        self.place = {i: p for p, i in enumerate(self.ids.tolist())}
        self.blocks_scored = self.blocks_skipped = 0

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (1 + np.log(counts)) * self.idf[terms] if len(terms) else np.zeros(0)
        norm = np.sqrt((values * values).sum())
        return (terms, values / norm) if norm > 0 else (terms[:0], values[:0])

    @functools.cached_property
    def _lists(self):
        """Made by each worker: the column of each term, the frequent terms' weights by
        block, their maxima, and the other terms' posting lists."""
        column = np.full(len(self.idf), -1)
        column[self.frequent] = np.arange(len(self.frequent))
        blocks = -(-len(self.ids) // BLOCK)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        inside = column[self.terms] >= 0
        dense = np.zeros((blocks * BLOCK, len(self.frequent)), np.float32)
        dense[owner[inside], column[self.terms[inside]]] = self.values[inside]
        dense = dense.reshape(blocks, BLOCK, len(self.frequent))
        terms, owner, values = self.terms[~inside], owner[~inside], self.values[~inside]
        order = np.argsort(terms, kind="stable")
        begins = np.searchsorted(terms[order], np.arange(len(self.idf) + 1))
        return column, dense, dense.max(axis=1), begins, owner[order], values[order]

    def nearest(self, queries: list, own: list | None = None, k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """For each unit vector ``(terms, values)`` the ``k`` best (cosine, place) above 0,
        ties to the smaller id, without the example that has the id in ``own``."""
        if not len(self.ids) or not queries:
            return [[] for _ in queries]
        column, dense, most, begins, owner, weights = self._lists
        blocks, rows = len(dense), np.arange(len(queries))
        q = np.zeros((len(queries), len(self.frequent)), np.float32)
        sums = np.zeros((len(queries), blocks * BLOCK), np.float32)
        for i, (terms, values) in enumerate(queries):
            at = column[terms]
            q[i, at[at >= 0]] = values[at >= 0]
            rare = at < 0
            begin = begins[terms[rare]]
            n = begins[terms[rare] + 1] - begin
            if n.any():
                list_at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
                sums[i] = np.bincount(
                    owner[list_at], np.repeat(values[rare], n) * weights[list_at], blocks * BLOCK
                )
            place = self.place.get(own[i]) if own else None
            if place is not None:
                sums[i, place] = -4
        sums = sums.reshape(len(queries), blocks, BLOCK)
        sums[:, -1, len(self.ids) - blocks * BLOCK + BLOCK :] = -4
        bounds = q @ most.T + sums.max(axis=2)
        order = np.argsort(-bounds, axis=1)
        scores = np.full(sums.shape, -4, np.float32)
        least = np.zeros(len(queries), np.float32)  # cosines of 0 are no neighbours
        top = np.full((len(queries), k), -4, np.float32)  # the best so far
        done, step = 0, FIRST
        while done < blocks:
            next_ = order[:, done : done + step]
            reach = np.take_along_axis(bounds, next_, axis=1)
            wanted = np.zeros((len(queries), blocks), bool)
            np.put_along_axis(wanted, next_, (reach > 0) & (reach >= least[:, None] - 2 * ERROR), axis=1)
            if not wanted.any():
                break  # bounds fall, and the k-th best only rises
            for b in np.flatnonzero(wanted.any(axis=0)):
                some = wanted[:, b]
                if 2 * some.sum() > len(some):  # cheaper than to pick them out
                    scores[:, b] = np.where(some[:, None], sums[:, b] + q @ dense[b].T, scores[:, b])
                else:
                    scores[some, b] = sums[some, b] + q[some] @ dense[b].T
            self.blocks_scored += int(wanted.sum())
            new = np.take_along_axis(scores, next_[:, :, None], axis=1).reshape(len(queries), -1)
            top = np.partition(np.concatenate([top, new], axis=1), -k, axis=1)[:, -k:]
            least = np.maximum(least, top[:, 0])
            done, step = done + step, step * 8
        self.blocks_skipped = self.blocks_skipped + len(queries) * blocks - int((scores[:, :, 0] > -4).sum())
        return [
            self._ranked(x, np.flatnonzero((s > 0) & (s >= t - 2 * ERROR)), s, k)
            for x, s, t in zip(queries, scores.reshape(len(queries), -1), least)
        ]

    def _ranked(self, query: tuple, places: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` best of ``places``. Where sums in single precision are too near each
        other to tell, cosines are added up again in double precision."""
        cosines = scores[places].astype(float)
        order = np.argsort(-cosines)
        close = np.flatnonzero(-np.diff(cosines[order]) < 2 * ERROR)
        unsure = order[np.union1d(close, close + 1)]
        cosines[unsure] = self._cosines(query, places[unsure])
        order = np.lexsort((self.ids[places], -np.round(cosines, 12)))[:k]
        return [(float(cosines[i]), int(places[i])) for i in order]

    def _cosines(self, query: tuple, places: np.ndarray) -> np.ndarray:
        if not len(places):
            return np.zeros(0)
        terms, values = query
        self._query[terms] = values
        n = self.at[places + 1] - self.at[places]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.at[places] - (ends - n), n)
        found = np.add.reduceat(self._query[self.terms[at]] * self.values[at], ends - n)
        self._query[terms] = 0
        return found

    @functools.cached_property
    def _query(self) -> np.ndarray:
        """A query's weights by term, while it is compared."""
        return np.zeros(len(self.idf))

    def vote(self, best: list[tuple[float, int]]) -> float:
        """Weighted share of toxic neighbours; without any, the rate of toxic documents."""
        up, total = 1e-3 * self.prior, 1e-3
        for cosine, place in best:
            w = self.weights[int(self.toxic[place])] * cosine / (1.05 - min(cosine, 1.0))
            up, total = up + w * self.toxic[place], total + w
        return up / total


def _log_odds(share):
    return np.log((share + 1e-3) / (1 - share + 1e-3))


def fitted_curve(votes: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, by Newton's method with a slight
    pull towards the votes themselves; a falling curve is not taken."""
    if not 0 < toxic.sum() < len(toxic):
        return 1.0, 0.0
    x = np.stack([_log_odds(votes), np.ones(len(votes))], axis=1)
    weights = weights / weights.mean()
    at = start = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ at)))
        slope = x.T @ (weights * (p - toxic)) + (at - start)
        curvature = (x * (weights * p * (1 - p))[:, None]).T @ x + np.eye(2)
        at = at - np.linalg.solve(curvature, slope)
    return (float(at[0]), float(at[1])) if np.isfinite(at).all() and at[0] > 0 else (1.0, 0.0)


def similar_together(vectors: list, frequent: np.ndarray, size: int, rounds: int = 4) -> np.ndarray:
    """An order of the examples in which those with similar frequent terms are neighbours:
    by the nearest of some centres, these by their own likeness."""
    n = len(vectors)
    if n <= BLOCK or not len(frequent):
        return np.arange(n)
    column = np.full(size, -1)
    column[frequent] = np.arange(len(frequent))
    x = np.zeros((n, len(frequent)), np.float32)
    for i, (terms, values) in enumerate(vectors):
        at = column[terms]
        x[i, at[at >= 0]] = values[at >= 0]
    centres = x[:: max(1, BLOCK // 4)].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        for c in np.unique(nearest):
            total = x[nearest == c].sum(axis=0)
            centres[c] = total / max(float(np.sqrt((total * total).sum())), 1e-9)
    along = np.linalg.svd(centres, full_matrices=False)[0][:, 1]
    return np.lexsort((np.arange(n), nearest, along[nearest]))


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Documents in all, and how many hold each term: partial counts for each task, then
    a sum by term."""
    n = len(vocabulary)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n + 1, np.int64)
        for batch in batches:
            for terms, _ in known_terms(batch.column("text"), known.value):
                seen[terms] += 1
                seen[n] += 1
        held = np.flatnonzero(seen)
        for at in range(0, len(held), 1 << 16):
            piece = held[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(seen[piece])], ["term", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = rows.toArrow()  # at most one row for each term of the examples
    seen = np.zeros(n + 1)
    seen[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(seen[n]), seen[:n]


def build_index(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES):
    """Broadcast ``(vocabulary, index)`` of the labelled rows that are not held out, and the
    curve of their votes."""
    marked = store(
        labels.where("toxic is not null and doc_id is not null and not " + held_out(4, 2))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")),
        "toxicity-labels",
    )
    counts = {int(t): n for t, n in marked.groupBy("toxic").count().collect()}
    share = {t: min(1.0, examples / n) for t, n in counts.items()}
    pick = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < F.when(
        F.col("toxic") == 1, int(share.get(1, 0) * 1_000_003) + 1
    ).otherwise(int(share.get(0, 0) * 1_000_003) + 1)
    # The sample is bounded, so its ids may be broadcast. Of several texts under one id the
    # one with the smallest digest is the example.
    drawn = docs.join(F.broadcast(marked.where(pick)), "doc_id").select("doc_id", "toxic", "text")
    chosen = drawn.groupBy("doc_id", "toxic").agg(F.min_by("text", F.md5("text")).alias("text"))
    drawn = store(chosen, "toxicity-examples")
    rows = drawn.orderBy("doc_id").collect()
    texts = pa.array([r.text for r in rows], pa.large_string())
    toxic = np.array([int(r.toxic) for r in rows], np.int64)
    vocabulary = all_terms(texts)
    total, frequency = _frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    votes = (share.get(1, 1) / max(share.get(0, 1), 1e-9), 1.0)  # a clean, a toxic example
    found = list(known_terms(texts, vocabulary))
    up, down = votes[1] * toxic.sum(), votes[0] * (1 - toxic).sum()
    prior = float((up + 0.5) / (up + down + 10)) if len(rows) else 0.0
    index = Index([r.doc_id for r in rows], toxic, found, idf, votes, prior)
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, index))
    left_out = map_batches(drawn.select("doc_id", "toxic", "text"), _votes(model, evidence=False), "doc_id long, vote double")
    voted = {r.doc_id: r.vote for r in left_out.collect()}  # a row for each example
    weights = np.where(toxic == 1, votes[1], votes[0])
    return model, fitted_curve(np.array([voted[r.doc_id] for r in rows]), toxic, weights)


def _votes(model, evidence: bool):
    """Votes of texts, without the example that has their own doc_id, and who voted."""

    def run(batch: pa.RecordBatch) -> dict:
        vocabulary, index = model.value
        out: dict[str, list] = {"vote": [], "neighbours": [], "similarities": []}
        found = [index.vector(*x) for x in known_terms(batch.column("text"), vocabulary)]
        own = batch.column("doc_id").to_pylist()
        for at in range(0, len(found), QUERIES):
            for best in index.nearest(found[at : at + QUERIES], own[at : at + QUERIES]):
                out["vote"].append(index.vote(best))
                if evidence:
                    out["neighbours"].append([int(index.ids[place]) for _, place in best])
                    out["similarities"].append([cosine for cosine, _ in best])
        return {"doc_id": batch.column("doc_id"), **out}

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``, repeated ones too: doc_id, held_out, score (0 to 1, the
    probability of being toxic), predicted, neighbours (doc_ids of the nearest examples,
    nearest first), similarities (their cosines, to five digits at least).

    ``labels`` has doc_id and toxic; a document is toxic if any row of its says so. Null
    texts count as empty. Texts without any term of the examples, the empty one included,
    have no neighbours and the score of the rate of toxic documents. Without examples of
    both classes votes are not calibrated.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    model, (slope, offset) = build_index(docs, labels, examples)
    odds = "ln((vote + 1e-3D) / (1D - vote + 1e-3D))"
    kinds = "doc_id long, vote double, neighbours array<long>, similarities array<double>"
    return (
        map_batches(docs, _votes(model, evidence=True), kinds)
        .selectExpr("*", f"1D / (1D + exp(-({slope!r}D * {odds} + {offset!r}D))) as score")
        .selectExpr(
            "doc_id", f"{held_out(4, 2)} as held_out", "score",
            f"case when score >= {threshold} then 1 else 0 end as predicted",
            "neighbours", "similarities",
        )
    )
