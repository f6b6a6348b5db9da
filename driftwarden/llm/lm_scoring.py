"""Cross-entropy difference between matched n-gram models.

A target model learns from trusted texts and a background model from all texts. Both
share one vocabulary: every word of the corpus. The most frequent words are classes of
their own and all others fall into hashed classes; the probability of a word is that of
its class after the class before it, times that of the word within its class. Words,
then pairs of classes, are counted over the whole corpus: each task adds up its own
texts, Spark adds up the tasks. The pairs are square matrices whose size the classes
fix; the table of words grows with the corpus.

Words that make up at least one of ``COMMON`` tokens each (no more than ``COMMON`` words
can) travel with the scoring tasks. All others stay in a table that Spark joins with the
rarer words of the texts; such a word has few rows by definition, so the join has no hot
key. A text's score is the mean over its tokens of the target loss less the background
loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .common import bounded_batches, map_batches, read, store
from .decontamination import FILTER_BITS, bloom_filter, bloom_probes

WORDS, CLASSES = 767, 256  # symbols are 0 (start), words, classes
SYMBOLS = 1 + WORDS + CLASSES
MIX = 0.7  # of the bigram estimate; the rest is the unigram estimate
SMOOTH = 0.01  # added to the count of every symbol; small, since the target may be small
WITHIN = 0.5  # added to the count of every word within its class
COMMON = 1 << 20  # a word with this share of all tokens is scored inside the tasks
_HELD = 1 << 20  # distinct words after which a task's counts are merged


def tokens(texts: pa.Array) -> Iterator[np.ndarray]:
    for begin, end in hashing.chunks(texts):
        words, at = hashing.word_hashes(texts.slice(begin, end - begin), hashing.PUNCTUATION)
        for i in range(end - begin):
            yield words[at[i] : at[i + 1]]


def word_class(words: np.ndarray) -> np.ndarray:
    return (hashing.mix(words) % np.uint64(CLASSES)).astype(np.int64)


def symbols(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Symbols of word hashes; ``vocabulary`` holds the sorted hashes of frequent words."""
    other = 1 + WORDS + word_class(words)
    if not len(vocabulary):
        return other
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, 1 + at, other)


def _merged(parts: list) -> list:
    keys = np.concatenate([k for k, _ in parts])
    amounts = np.concatenate([n for _, n in parts])
    found, place = np.unique(keys, return_inverse=True)
    return [(found, np.bincount(place, amounts, len(found)).astype(np.int64))]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, n) by hash over all texts; one partial count for each word and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            texts = batch.column("text")
            for begin, end in hashing.chunks(texts):
                words, _ = hashing.word_hashes(texts.slice(begin, end - begin), hashing.PUNCTUATION)
                parts.append(np.unique(words, return_counts=True))
                held += len(parts[-1][0])
                if held > 4 * _HELD:
                    parts = _merged(parts)
                    held = len(parts[0][0])
                    if held > 2 * _HELD:
                        yield from _rows(parts[0])
                        parts, held = [], 0
        if parts:
            yield from _rows(_merged(parts)[0])

    def _rows(part) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(part[0]), 1 << 16):
            piece = slice(at, at + (1 << 16))
            words, n = part[0][piece], part[1][piece]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(word_class(words)), pa.array(n)], ["word", "class", "n"]
            )

    bounded_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "word long, class long, n long")
    return found.groupBy("word", "class").agg(F.sum("n").alias("n"))


def word_losses(everywhere: DataFrame, target: DataFrame, frequent: DataFrame) -> DataFrame:
    """(word, n, target_loss, background_loss) of every word that is not ``frequent``:
    negative log probabilities within its class. ``everywhere`` and ``target`` are word
    counts; ``frequent`` has at most ``WORDS`` rows."""
    words = (
        everywhere.join(F.broadcast(frequent.select("word")), "word", "left_anti")
        .join(target.selectExpr("word", "n as target"), "word", "left")
        .selectExpr("word", "class", "n", "coalesce(target, 0) as target")
    )
    words = store(words, "lm-words")
    classes = words.groupBy("class").agg(
        F.count("*").alias("size"), F.sum("n").alias("all_n"), F.sum("target").alias("all_target")
    )
    loss = "-ln(({0} + {1}D) / (all_{0} + {1}D * size)) as {2}_loss"
    return words.join(F.broadcast(classes), "class").selectExpr(  # at most CLASSES rows
        "word", "n", loss.format("target", WITHIN, "target"), loss.format("n", WITHIN, "background")
    )


def pair_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(pair, n) over all texts; one partial count for each pair of symbols and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for words in tokens(batch.column("text")):
                if len(words):
                    s = symbols(words, vocabulary)
                    np.add.at(seen, np.concatenate([[0], s[:-1]]) * SYMBOLS + s, 1)
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 1 << 16):
            piece = found[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(seen[piece])], ["pair", "n"])

    return docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_matrix(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    counts = np.zeros(SYMBOLS * SYMBOLS)
    for r in store(pair_counts(docs, vocabulary), "pair-counts").toLocalIterator():  # at most SYMBOLS squared
        counts[r.pair] = r.n
    return counts.reshape(SYMBOLS, SYMBOLS)


def target_texts(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(text) of the documents whose doc_id is in ``marks`` (doc_id, distinct).

    Texts first meet a Bloom filter of the ids, whose size is bounded, so that hardly
    any others travel to the exact join."""

    def hashed(ids: pa.Array) -> np.ndarray:
        return hashing.mix(ids.fill_null(0).to_numpy().view(np.uint64))

    keys = map_batches(marks, lambda batch: {"hash": hashed(batch.column("doc_id")).view(np.int64)}, "hash long")
    bits = int(np.clip(np.ceil(np.log2(max(marks.count(), 1) * 16)), 16, FILTER_BITS))
    maybe = docs.sparkSession.sparkContext.broadcast(np.packbits(bloom_filter(keys, bits), bitorder="little"))

    def likely(batch: pa.RecordBatch) -> dict:
        values = hashed(batch.column("doc_id"))
        hit = np.ones(len(values), bool)
        for at in bloom_probes(values, bits):
            hit &= (maybe.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        found = batch.filter(pa.array(hit))
        return {c: found.column(c) for c in ("doc_id", "text")}

    return map_batches(docs, likely, "doc_id long, text string").join(marks, "doc_id").select("text")


def losses(counts: np.ndarray) -> np.ndarray:
    """Negative log probability of a symbol (column) after another (row)."""
    single = counts.sum(0) + SMOOTH
    single[0] = 0  # nothing is followed by the start
    single = single / single.sum()
    after = counts.sum(1, keepdims=True)
    mixed = np.where(after > 0, MIX, 0.0)
    both = mixed * counts / np.maximum(after, 1) + (1 - mixed) * single
    return -np.log(np.maximum(both, 1e-300)).astype(np.float32)


def _text_losses(model, vocabulary: np.ndarray):
    """Sums of losses over the tokens of each text, and the words left to the join."""

    def run(batch: pa.RecordBatch) -> dict:
        target, background, common, within = model.value
        out: dict[str, list] = {k: [] for k in ("n_tokens", "target", "background", "words", "counts")}
        for words in tokens(batch.column("text")):
            s = symbols(words, vocabulary)
            before = np.concatenate([[0], s[:-1]]).astype(np.int64)
            rare, counts = np.unique(words[s > WORDS], return_counts=True)
            at = np.minimum(np.searchsorted(common, rare), max(len(common) - 1, 0))
            known = common[at] == rare if len(common) else np.zeros(len(rare), bool)
            inside = within[:, at[known]] @ counts[known] if known.any() else np.zeros(2)
            out["n_tokens"].append(len(s))
            out["target"].append(float(target[before, s].sum(dtype=float) + inside[0]) if len(s) else 0.0)
            out["background"].append(float(background[before, s].sum(dtype=float) + inside[1]) if len(s) else 0.0)
            out["words"].append(rare[~known].view(np.int64))
            out["counts"].append(counts[~known])
        return {"doc_id": batch.column("doc_id"), "version": batch.column("version"), **out}

    return run


def cross_entropy_difference(docs: DataFrame, trusted: DataFrame, common: int = COMMON) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss and
    score, their difference (below 0: closer to the target), each a mean over tokens.

    ``trusted`` has the doc_id of target texts. Null texts count as empty; texts without
    tokens have losses and score 0. Without trusted texts both models are the same one
    and every score is 0.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    everywhere = store(word_counts(docs), "lm-counts")
    top = everywhere.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    vocabulary = np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))
    frequent = spark.createDataFrame([(r.word,) for r in top], "word long")
    marks = store(
        trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "lm-marks"
    )
    good = store(target_texts(docs, marks), "lm-target")
    counts = np.stack([pair_matrix(good, vocabulary), pair_matrix(docs, vocabulary)])
    if counts[0].any():
        target = word_counts(good)
    else:
        target, counts[0] = everywhere, counts[1]
    words = store(word_losses(everywhere, target, frequent), "lm-losses")
    least = int(counts[1].sum()) / common
    near = words.where(F.col("n") >= least).drop("n").orderBy("word").toArrow()  # at most ``common`` rows
    keys = near["word"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    within = np.stack([near[c].to_numpy()[order] for c in ("target_loss", "background_loss")])
    # Two matrices of 4 MB, and 24 bytes for each common word.
    model = spark.sparkContext.broadcast((*(losses(c) for c in counts), keys[order], within))

    # Equal texts have equal sums, so rows with the same doc_id and text may share theirs.
    key = ["doc_id", "version"]
    scored = store(
        map_batches(
            docs.withColumn("version", F.xxhash64("text")), _text_losses(model, vocabulary),
            "doc_id long, version long, n_tokens long, target double, background double, "
            "words array<long>, counts array<long>",
        ),
        "lm-texts",
    )
    rest = (
        scored.selectExpr(*key, "explode(arrays_zip(words, counts)) as w")
        .selectExpr(*key, "w.words as word", "w.counts as times")
        .join(words.where(F.col("n") < least), "word")
        .groupBy(*key)
        .agg(*[F.expr(f"sum({c}_loss * times) / sum(times) as {c}_rest") for c in ("target", "background")])
        .toDF("id", "of", "target_rest", "background_rest")
    )
    left = "aggregate(counts, 0L, (s, x) -> s + x)"
    mean = "case when n_tokens > 0 then ({0} + " + left + " * coalesce({0}_rest, 0)) / n_tokens else 0D end as {0}_loss"
    return scored.join(rest, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("version") == F.col("of")), "left").selectExpr(
        "doc_id", "n_tokens", mean.format("target"), mean.format("background")
    ).selectExpr("*", "target_loss - background_loss as score")


def trusted_documents(spark, folder: str) -> DataFrame:
    """Documents that ``labels`` marks as good."""
    return read(spark, folder, "labels").where("quality = 1").select("doc_id")
