"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network that minimises the
non-negative unbiased risk: the positives' loss weighted with the class prior, plus the
unlabelled loss as negatives less the part that the positives explain, never below
zero. The prior is estimated first: no region of scores can hold a smaller share of
unlabelled than prior times its share of positives, so the smallest such ratio over
regions that are large enough bounds it. Shares are counted over all documents.

Features are shape and repetition measures of the whole text. Their mean and spread
come from all documents. Only the fit uses samples, of at most about ``SAMPLE``
positives and as many unlabelled texts, drawn by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .common import map_batches, store

SAMPLE = 20_000
THRESHOLD = 0.3
HIDDEN, EPOCHS, BATCH, RATE = 16, 40, 512, 0.01

FEATURES = (
    "length", "words", "word_length", "punctuation", "capitals", "digits", "breaks",
    "bars", "signs", "exclamations", "distinct_words", "repeats", "top_word",
    "distinct_triples", "marked_words", "bare_marks", "single_letters", "long_words",
)

_SIGNS = np.isin(np.arange(256), list(b"#$%&*+<=>@\\^_`{}~/"))
_DIGITS = np.isin(np.arange(256), list(b"0123456789"))
_MARKS = hashing.PUNCTUATION & ~hashing.SPACE


def _shares(flags: np.ndarray, bounds: np.ndarray, total: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(total, 1)


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text; null is the empty text."""
    low, starts, ends, at = hashing.word_spans(texts)
    bounds = np.concatenate([[0], np.cumsum(hashing.byte_lengths(texts))])
    words = hashing.span_hashes(low, starts, ends)
    size, count = np.diff(bounds), np.diff(at)
    raw = hashing.raw_bytes(texts)[0]
    # Two-byte capitals of Latin-1 count like A-Z.
    accents = np.zeros(len(raw), bool)
    accents[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    capital = ((raw >= 65) & (raw <= 90)) | accents
    lengths = ends - starts
    marks = np.concatenate([[0], np.cumsum(_MARKS[low])])
    marked = (marks[ends] - marks[starts]) if len(starts) else np.zeros(0, int)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[at[:-1][count > 0]] = False
    distinct, top, triples = (np.zeros(len(size)) for _ in range(3))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b > a:
            _, counts = np.unique(words[a:b], return_counts=True)
            distinct[i], top[i] = len(counts) / (b - a), counts.max() / (b - a)
            sequences = hashing.shingles(words[a:b], 3)
            triples[i] = len(np.unique(sequences)) / len(sequences)
    return np.column_stack([
        np.log1p(size), np.log1p(count), _shares(lengths, at, count),
        _shares(_MARKS[low], bounds, size), _shares(capital, bounds, size),
        _shares(_DIGITS[low], bounds, size), _shares(low == 10, bounds, count),
        _shares(low == 124, bounds, count), _shares(_SIGNS[low], bounds, size),
        _shares(low == 33, bounds, count), distinct, _shares(again, at, count), top, triples,
        _shares(marked > 1, at, count), _shares(marked == lengths, at, count),
        _shares(lengths == 1, at, count), _shares(lengths > 20, at, count),
    ])


def _features(batch: pa.RecordBatch) -> dict:
    texts = batch.column("text")
    rows = [
        text_features(texts.slice(a, b - a)).astype(np.float32) for a, b in hashing.chunks(texts)
    ]
    return {"doc_id": batch.column("doc_id"), "f": list(np.concatenate(rows))}


class Network:
    """One hidden layer; ``score`` gives a probability."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        n = len(FEATURES)
        self.parts = [draw.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN),
                      draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def margin(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.parts
        hidden = np.tanh(x @ w + b)
        return hidden @ v + c[0], hidden

    def slopes(self, x: np.ndarray, hidden: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = np.outer(g, self.parts[2]) * (1 - hidden**2)
        return [x.T @ back, back.sum(0), hidden.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x)[0])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) under the logistic loss."""
    net, draw = Network(seed), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parts]
    second = [np.zeros_like(p) for p in net.parts]
    step = 0
    batches = max(1, max(len(positive), len(unlabelled)) // BATCH)
    for _ in range(EPOCHS):
        ps = np.array_split(draw.permutation(max(len(positive), batches)) % len(positive), batches)
        us = np.array_split(draw.permutation(max(len(unlabelled), batches)) % len(unlabelled), batches)
        for i, j in zip(ps, us):
            xp, xu = positive[i], unlabelled[j]
            (zp, hp), (zu, hu) = net.margin(xp), net.margin(xu)
            # Losses: log(1 + e^-z) as positive, log(1 + e^z) as negative.
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            as_negative_p, as_negative_u = _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
            if rest >= 0:
                gp = -prior * _sigmoid(-zp) / len(zp) - prior * as_negative_p
                gu = as_negative_u
            else:  # step back from the part that went below zero
                gp, gu = prior * as_negative_p, -as_negative_u
            slopes = [a + b for a, b in zip(net.slopes(xp, hp, gp), net.slopes(xu, hu, gu))]
            step += 1
            for k, s in enumerate(slopes):
                s = s + 1e-4 * net.parts[k]
                first[k] = 0.9 * first[k] + 0.1 * s
                second[k] = 0.999 * second[k] + 0.001 * s * s
                net.parts[k] = net.parts[k] - RATE * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return net


def score_grid(positive: np.ndarray) -> np.ndarray:
    """At most 100 scores that at least a fifth of the positives exceed, rising."""
    top = np.sort(positive)[::-1]
    return np.unique(top[np.unique(np.linspace(len(top) * 0.2, len(top) - 1, 100).astype(int))])


def smallest_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The smallest ratio of unlabelled to positive shares above a score, with an allowance
    for chance. Either has the rows in all, then those at or above each score."""
    p, u = positive[1:] / max(positive[0], 1), unlabelled[1:] / max(unlabelled[0], 1)
    chance = np.sqrt(1 / max(unlabelled[0], 1)) + np.sqrt(1 / max(positive[0], 1))
    best = np.argmin((u + chance) / np.maximum(p, 1e-12))
    return float(np.clip(u[best] / max(p[best], 1e-12), 0.01, 0.99))


def at_least(scores: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """How many scores there are, then how many are at or above each of the rising ``grid``."""
    passed = np.bincount(np.searchsorted(grid, scores, "right"), minlength=len(grid) + 1)
    return np.cumsum(passed[::-1])[::-1]


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    grid = score_grid(positive)
    return smallest_ratio(at_least(positive, grid), at_least(unlabelled, grid))


def _all_at_least(rows: DataFrame, grid: np.ndarray, score) -> np.ndarray:
    """``at_least`` over the features of all ``rows``: a row of counts for each batch, then
    one sum."""

    def count(batch: pa.RecordBatch) -> dict:
        found = at_least(score(_matrix(batch)), grid)
        return {"place": np.arange(len(found)), "n": found}

    counts = map_batches(rows.select("f"), count, "place int, n long").groupBy("place").agg(F.sum("n"))
    total = np.zeros(len(grid) + 1)
    for place, n in counts.collect():  # at most one row for each score of the grid
        total[place] = n
    return total


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack(batch.column("f").to_numpy(zero_copy_only=False)).astype(float)


def _sample(rows: DataFrame, size: int) -> np.ndarray:
    """At most about ``size`` rows, drawn by a hash of key and features."""
    total = rows.count()
    share = min(1.0, size / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", "f", F.lit(11)), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    found = [r[0] for r in drawn.orderBy(F.xxhash64("doc_id", "f", F.lit(12))).select("f").collect()]
    return np.array(found, np.float64).reshape(-1, len(FEATURES))


def held_out(modulus: int, remainder: int) -> str:
    """SQL: whether a document is kept from learning. Rows without doc_id are not."""
    return f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {remainder}, false)"


def quality_scores(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1, higher: better),
    predicted (1 if score >= threshold).

    ``labels`` has doc_id and quality; documents labelled 1 by every row of theirs are
    the positives, unless held out. Null texts count as empty. Without positives or
    documents nothing can be learnt and every score is 0.5.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    features = store(map_batches(docs, _features, "doc_id long, f array<float>"), "quality-features")
    good = (
        labels.where("quality is not null and doc_id is not null and not " + held_out(5, 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
        .where("q = 1").select("doc_id")
    )
    trusted = features.join(good, "doc_id")
    positive = _sample(trusted, sample)
    unlabelled = _sample(features.select("doc_id", "f"), sample)
    shape = features.agg(*[g(F.col("f")[i]) for g in (F.avg, F.stddev_pop) for i in range(len(FEATURES))]).first()
    n = len(FEATURES)
    if not len(positive):
        scored = features.selectExpr("doc_id", "cast(0.5 as double) as score")
    else:
        mean, spread = np.array(shape[:n], float), np.maximum(np.array(shape[n:], float), 1e-3)
        clean = lambda x: np.clip((x - mean) / spread, -8, 8)
        xp, xu = clean(positive), clean(unlabelled)
        apart = fit_nnpu(xp, xu, 0.5)
        first = lambda x: apart.score(clean(x))
        grid = score_grid(first(positive))
        prior = smallest_ratio(_all_at_least(trusted, grid, first), _all_at_least(features, grid, first))
        net = fit_nnpu(xp, xu, prior)

        def score(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "score": net.score(clean(_matrix(batch)))}

        scored = map_batches(features, score, "doc_id long, score double")
    return scored.selectExpr(
        "doc_id", f"{held_out(5, 0)} as held_out", "score",
        f"case when score >= {threshold} then 1 else 0 end as predicted",
    )
