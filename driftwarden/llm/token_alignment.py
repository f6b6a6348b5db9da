"""Alignment of two tokenizers' tokens through the byte ends that they share.

Both token lists tile the same bytes, so a byte offset where both end a token cuts the
text into groups of tokens that cover the same bytes. The shared ends come from a
galloping intersection: the shorter list drives, from the place of the value before the
steps into the longer one double until they pass the value, and a binary search ends
between the last two. The ranks of shared ends slice both lists; differences of
neighbouring ranks are the sizes of a group on either side.

How many documents link a pair of ids is counted by Spark, from each document's distinct
pairs, combined on the map side. Counts come back to the documents on two roads: those of
the most frequent pairs, at most ``COMMON`` of them, travel with the tasks; all rarer
ones are joined by pair, so that no pair that is in a large share of the documents meets
in one task.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import byte_symbols
from .common import map_batches, store
from .piece_spans import SPACE, decimals, piece_model

COMMON = 1 << 20  # pairs whose counts travel with the tasks, 17 bytes each
LANES = 16  # values that start from one place of the longer list
TOKENS_AT_ONCE = 1 << 18  # tokens of the texts that are aligned together
LINKS_AT_ONCE = 1 << 16  # links of a group that is expanded; larger ones go by distinct ids
BLANKS = re.compile(r"\s{1000}")


class ByteCoder:
    """Byte-level BPE of a tokenizer file, special tokens read as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        value = {c: b for b, c in enumerate(byte_symbols())}
        self.tokens = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            # Special tokens are never found; their strings need not be byte symbols.
            self.tokens[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.lengths = np.array([len(t) for t in self.tokens])
        self.fast = self._ranked(model)

    def _ranked(self, model: dict):
        """The same model in a faster library, where ids are in the order of merges: a
        piece is then merged by the ids alone."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocabulary = model["vocab"]
        if any(vocabulary[a + b] != 256 + rank for rank, (a, b) in enumerate(pairs)):
            return None
        import public_tokenizers
        import tiktoken

        ranks = {self.tokens[i]: i for i in range(256 + len(pairs))}
        if len(ranks) != 256 + len(pairs):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not BLANKS.search(text):  # its pattern recurses over blanks
            return np.array(self.fast.encode_ordinary(text), np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


class PieceCoder:
    """A piece model; a space before the text is its own doing."""

    def __init__(self, path: str):
        self.model = piece_model(path)
        self.tokens = [
            bytes([int(p[3:-1], 16)]) if b else p.replace(SPACE, " ").encode()
            for p, b in zip(self.model.pieces, self.model.is_byte)
        ]
        self.lengths = np.array([len(t) for t in self.tokens])

    def encode(self, text: str) -> np.ndarray:
        return self.model.ids_of(self.model.normalize.text(text))


@functools.cache
def coders(path_a: str, path_b: str) -> tuple[ByteCoder, PieceCoder]:
    """One pair for each worker process."""
    return ByteCoder(path_a), PieceCoder(path_b)


def places(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place of ``long`` that is not smaller, both
    ascending. Every ``LANES``-th value is placed first; the values between gallop from
    there side by side."""
    if not len(short) or not len(long):
        return np.zeros(len(short), np.int64)
    if len(short) <= LANES:
        start = np.zeros(len(short), np.int64)
    else:
        start = np.repeat(places(short[::LANES], long), LANES)[: len(short)]
    n, low, high = len(long), start, start.copy()
    lanes, step = np.arange(len(short)), 1
    while True:
        at = high[lanes]
        lanes = lanes[(at < n) & (long[np.minimum(at, n - 1)] < short[lanes])]
        if not len(lanes):
            break
        low[lanes] = high[lanes] + 1
        high[lanes] = np.minimum(high[lanes] + step, n)
        step *= 2
    while True:
        lanes = np.flatnonzero(low < high)
        if not len(lanes):
            return low
        middle = (low[lanes] + high[lanes]) >> 1
        smaller = long[middle] < short[lanes]
        low[lanes[smaller]] = middle[smaller] + 1
        high[lanes[~smaller]] = middle[~smaller]


def shared(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the values that two strictly ascending lists share."""
    if len(first) > len(second):
        return shared(second, first)[::-1]
    at = places(first, second)
    hit = np.flatnonzero(at < len(second))
    hit = hit[second[at[hit]] == first[hit]]
    return hit, at[hit]


def pairs_of(group: np.ndarray, a: np.ndarray, b: np.ndarray, ends_a, ends_b, width: int):
    """Linked id pairs by group number: (group, a id x ``width`` + b id, times). Pairs of
    one group may come several times."""
    starts_a, starts_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
    size_a, size_b = ends_a - starts_a, ends_b - starts_b
    links = size_a * size_b
    some = np.flatnonzero(links <= LINKS_AT_ONCE)
    times = links[some]
    of = np.repeat(some, times)
    within = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    over, left = np.divmod(within, size_b[of])
    yield group[of], a[starts_a[of] + over].astype(np.int64) * width + b[starts_b[of] + left], np.ones(len(of), np.int64)
    for k in np.flatnonzero(links > LINKS_AT_ONCE):
        ids_a, times_a = np.unique(a[starts_a[k] : ends_a[k]], return_counts=True)
        ids_b, times_b = np.unique(b[starts_b[k] : ends_b[k]], return_counts=True)
        keys = (ids_a.astype(np.int64)[:, None] * width + ids_b).ravel()
        yield np.full(len(keys), group[k]), keys, np.outer(times_a, times_b).ravel()


def _aligned(texts: list[str | None], a: ByteCoder, b: PieceCoder, columns: str) -> Iterator[dict]:
    """What ``align_tokens`` stores of each text."""
    table, width = _table(len(a.tokens), len(b.tokens)), len(b.tokens)
    group, size = [], 0
    for text in [*texts, ...]:
        if group and (text is ... or size > TOKENS_AT_ONCE):
            yield from _together(group, a, b, table, width, columns)
            group, size = [], 0
        if text is ...:
            break
        ids_a = ids_b = np.zeros(0, np.int32)
        if text:
            raw = (" " + text).encode()
            ids_a, ids_b = a.encode(" " + text), b.encode(text)
            if any(b"".join(map(c.tokens.__getitem__, i.tolist())) != raw for c, i in ((a, ids_a), (b, ids_b))):
                ids_a = ids_b = np.zeros(0, np.int32)
        group.append((ids_a, ids_b))
        size += len(ids_a) + len(ids_b)


def _together(group: list, a: ByteCoder, b: PieceCoder, table: np.ndarray, width: int, columns: str) -> Iterator[dict]:
    """Texts one after another are one list of bytes; the end of each is shared."""
    ids_a, ids_b = (np.concatenate(x) for x in zip(*group))
    sizes_a, sizes_b = (np.array([len(x) for x in ids]) for ids in zip(*group))
    last_a, last_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    rank_a, rank_b = shared(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b]))
    ends_a, ends_b = rank_a + 1, rank_b + 1
    text_of = np.searchsorted(last_a, ends_a, "left")
    cuts = np.searchsorted(text_of, np.arange(len(group) + 1))
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    links = np.bincount(text_of, size_a * size_b, len(group)).astype(np.int64)

    # Groups written out: the tokens of a, a bar, the tokens of b, a semicolon.
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    place_a = np.arange(len(ids_a)) + np.repeat(ends_b - size_b, size_a)
    place_b = np.arange(len(ids_b)) + np.repeat(ends_a, size_b)
    codes[place_a], codes[place_b] = ids_a, 2 * len(a.tokens) + ids_b
    codes[place_a[rank_a]] += len(a.tokens)
    codes[place_b[rank_b]] += width

    span = len(a.tokens) * width
    keys, times = [], []
    for of, key, n in pairs_of(text_of, ids_a, ids_b, ends_a, ends_b, width):
        key, back = np.unique(of * span + key, return_inverse=True)
        keys.append(key)
        times.append(np.bincount(back, n, len(key)).astype(np.int64))
    if len(keys) > 1:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        keys, times = [key], [np.bincount(back, np.concatenate(times), len(key)).astype(np.int64)]
    (key,), (n,) = keys, times
    bounds = np.searchsorted(key, np.arange(len(group) + 1) * span)
    for k in range(len(group)):
        lo, hi = last_a[k] - sizes_a[k] + last_b[k] - sizes_b[k], last_a[k] + last_b[k]
        pairs, g = slice(bounds[k], bounds[k + 1]), slice(cuts[k], cuts[k + 1])
        text = table[codes[lo:hi]].tobytes().translate(None, b"\0")[:-1]
        found = {
            "n_a": sizes_a[k], "n_b": sizes_b[k], "n_groups": cuts[k + 1] - cuts[k], "n_links": links[k],
            "groups_sha256": hashlib.sha256(text).hexdigest() if text else "",
            "pairs": key[pairs] - k * span, "times": n[pairs],
        }
        if columns == "all":
            found["ids_a"], found["ids_b"] = group[k]
            found["ends_a"] = ends_a[g] - (last_a[k] - sizes_a[k])
            found["ends_b"] = ends_b[g] - (last_b[k] - sizes_b[k])
        yield found


@functools.cache
def _table(size_a: int, size_b: int) -> np.ndarray:
    return np.concatenate([decimals(size_a, ","), decimals(size_a, "|"), decimals(size_b, ","), decimals(size_b, ";")])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, columns: str = "digests") -> DataFrame:
    """Token groups of every whole text of ``docs`` under two tokenizers.

    ``path_a`` is a byte-level BPE file, read over a space and the text, ``path_b`` a piece
    model, which puts a space first by itself; every machine has both. One row per row of
    ``docs``, repeated ones too: doc_id, row (its number), n_a, n_b (tokens), n_groups,
    n_links (pairs of an a and a b token of one group), groups_sha256 (of the groups' ids
    as ``a1,a2|b1;a3|b2,b3``), pairs (distinct linked id pairs, a id x size of b's
    vocabulary + b id) and times (links of each). ``columns="all"`` adds ids_a, ids_b and
    ends_a, ends_b, the ranks behind the last token of each group.

    Texts that are null, empty, or that either tokenizer does not give back byte by byte
    have no tokens: zeros, no pairs, and '' for groups_sha256.
    """
    sizes = [len(c.tokens) for c in coders(path_a, path_b)]
    pair = "int" if sizes[0] * sizes[1] < 1 << 31 else "bigint"
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kinds = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{pair}>, times array<bigint>"
    if columns == "all":
        names += ["ids_a", "ids_b", "ends_a", "ends_b"]
        kinds += ", ids_a array<int>, ids_b array<int>, ends_a array<int>, ends_b array<int>"

    def run(batch: pa.RecordBatch) -> dict:
        rows = list(_aligned(batch.column("text").to_pylist(), *coders(path_a, path_b), columns))
        return {"doc_id": batch.column("doc_id"), **{c: [r[c] for r in rows] for c in names}}

    found = map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, kinds)
    return found.withColumn("row", F.monotonically_increasing_id())


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (rows that hold it linked) and best (no pair of the same a id has more)."""
    counted = store(
        aligned.selectExpr("explode(pairs) as pair").groupBy("pair").agg(F.count("*").alias("n")), "pair-counts"
    )
    counted = counted.withColumn("a", F.expr(f"pair div {size_b}"))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # at most a row for each id of a
    return counted.join(F.broadcast(most), "a").selectExpr("pair", "n", "n = most as best")


def link_strengths(aligned: DataFrame, counts: DataFrame, common: int = COMMON) -> DataFrame:
    """row, count_sum (of the pairs' counts, over links) and n_best (links whose pair is
    the best of its a id), for every row of ``aligned``."""
    spark = aligned.sparkSession
    steps = counts.groupBy(F.expr("cast(floor(8 * log2(n)) as int) as step")).count().collect()  # some hundred
    least, total = 1 << 62, 0
    for step, n in sorted(((r[0], r[1]) for r in steps), reverse=True):
        total += n
        if total > common:
            break
        least = step
    is_common = f"cast(floor(8 * log2(n)) as int) >= {min(least, 1 << 30)}"
    near = counts.where(is_common).toArrow()  # at most ``common`` rows
    order = np.argsort(keys := near["pair"].to_numpy())
    known = spark.sparkContext.broadcast((keys[order], near["n"].to_numpy()[order], near["best"].to_numpy(zero_copy_only=False)[order]))

    def run(batch: pa.RecordBatch) -> dict:
        keys, counts, best = known.value
        lists = batch.column("pairs")
        cuts = lists.offsets.to_numpy()
        pairs = lists.values.to_numpy()[cuts[0] : cuts[-1]]
        times = batch.column("times").values.to_numpy()[cuts[0] : cuts[-1]]
        cuts = cuts - cuts[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        of = np.repeat(np.arange(len(lists)), np.diff(cuts))
        sums, bests = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
        np.add.at(sums, of[hit], counts[at[hit]] * times[hit])
        np.add.at(bests, of[hit], best[at[hit]] * times[hit])
        left = np.searchsorted(of[~hit], np.arange(len(lists) + 1)).astype(np.int32)
        return {
            "row": batch.column("row"), "count_sum": sums, "n_best": bests,
            "pairs": pa.ListArray.from_arrays(left, pa.array(pairs[~hit])),
            "times": pa.ListArray.from_arrays(left, pa.array(times[~hit])),
        }

    kind = dict(aligned.dtypes)["pairs"]
    parts = store(
        map_batches(
            aligned.select("row", "pairs", "times"), run,
            f"row long, count_sum long, n_best long, pairs {kind}, times array<bigint>",
        ),
        "link-sums",
    )
    rest = (
        parts.selectExpr("row", "explode(arrays_zip(pairs, times)) as p")
        .selectExpr("row", "p.pairs as pair", "p.times as times")
        .join(counts.where(f"not ({is_common})"), "pair")
        .selectExpr("row", "n * times as count_sum", "if(best, times, 0L) as n_best")
    )
    both = parts.select("row", "count_sum", "n_best").union(rest)
    return both.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))


def aligned_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256, as ``align_tokens`` and ``link_strengths`` define them."""
    aligned = store(align_tokens(docs, path_a, path_b), "aligned")
    counts = store(pair_counts(aligned, len(coders(path_a, path_b)[1].tokens)), "pairs")
    strengths = link_strengths(aligned, counts)
    kept = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return kept.join(strengths, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
