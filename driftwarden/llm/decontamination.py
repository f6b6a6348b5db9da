"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens; the positions it ignores may be
substituted. Hashes of the kept tokens, at every place of every benchmark item and of
every training text, are joined, and around each hit the two texts are compared along
the hit's diagonal: the best run of matching tokens, in which substitutions cost, has
to be long enough.

Items of fewer than ``LONG`` tokens have few places, so lighter masks look for them: the
positions fall into four groups, and each mask keeps two. Whichever two positions of a
place are substituted, one mask ignores both. Longer items need only heavier masks, which
are met by chance less often.

Training texts yield hashes by the billion, so they first meet a Bloom filter of the
benchmark's hashes, whose size is set by the number of benchmark hashes and bounded.
It only spares rows: what passes is joined on exact hashes, and only tokens around
hits travel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import hashing
from .common import map_batches, store

#: 1: the token counts, 0: it may differ.
MASKS = ("11101100111", "11011011011", "11110001111")
SPAN = 11
GROUPS = 4  # of positions, by remainder; a light mask keeps two of them
LIGHT = tuple((a, b) for a in range(GROUPS) for b in range(a + 1, GROUPS))
LONG = 25  # tokens from which on the masks without gaps at the ends are enough
MATCHES = 10  # tokens that agree along the best run
PENALTY = 3  # what a substitution costs in matches
FILTER_BITS = 28  # at most 2^28 bits, 32 MB
_PROBES = 3


def seed_hashes(tokens: np.ndarray, heavy: bool = True, light: bool = True) -> np.ndarray:
    """A row for each mask, first the heavy ones, then the light ones; a column for each
    place. Texts shorter than the masks have none."""
    n = len(tokens) - SPAN + 1
    rows = len(MASKS) * heavy + len(LIGHT) * light
    out = np.zeros((rows, max(n, 0)), np.uint64)
    if n <= 0:
        return out
    factors = hashing.multipliers(SPAN + 1, 71)
    with np.errstate(over="ignore"):
        parts = [tokens[j : j + n] * factors[j] for j in range(SPAN)]
        for m, mask in enumerate(MASKS if heavy else ()):
            total = np.full(n, np.uint64(m + 10 * SPAN) * factors[SPAN])
            for j in range(SPAN):
                if mask[j] == "1":
                    total = total + parts[j]
            out[m] = hashing.mix(total)
        if light:
            groups = [np.add.reduce(parts[g::GROUPS]) for g in range(GROUPS)]
            for m, (a, b) in enumerate(LIGHT):
                number = np.uint64(len(MASKS) + m + 10 * SPAN) * factors[SPAN]
                out[rows - len(LIGHT) + m] = hashing.mix(groups[a] + groups[b] + number)
    return out


def short_hashes(tokens: np.ndarray, span: int) -> np.ndarray:
    """Hashes of all runs of ``span`` < SPAN tokens, as a short item has them."""
    factors = hashing.multipliers(SPAN + 1, 71)
    if len(tokens) < span:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(len(tokens) - span + 1, np.uint64(10 * span) * factors[SPAN])
        for j in range(span):
            total = total + tokens[j : len(tokens) - span + 1 + j] * factors[j]
    return hashing.mix(total)


def _tokens(texts: pa.Array):
    for begin, end in hashing.chunks(texts):
        words, at = hashing.word_hashes(texts.slice(begin, end - begin), hashing.PUNCTUATION)
        for i in range(end - begin):
            yield words[at[i] : at[i + 1]]


def _bench(batch: pa.RecordBatch) -> dict:
    out: dict[str, list] = {"item_id": [], "hash": [], "place": [], "tokens": []}
    for item, tokens in zip(batch.column("item_id").to_pylist(), _tokens(batch.column("text"))):
        if len(tokens) < SPAN:
            seeds = short_hashes(tokens, len(tokens))[None, :] if len(tokens) else []
        else:
            short = len(tokens) < LONG
            seeds = seed_hashes(tokens, heavy=not short, light=short)
        for row in seeds:
            for place, value in enumerate(row.view(np.int64).tolist()):
                out["item_id"].append(item)
                out["hash"].append(value)
                out["place"].append(place)
                out["tokens"].append(len(tokens))
    return out


def bloom_probes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    return [
        ((values >> np.uint64(20 * k)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        if 20 * k + bits <= 64
        else (hashing.mix(values + np.uint64(k)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        for k in range(_PROBES)
    ]


def packed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the hashes, eight bits a byte: words of set bits, combined by Spark;
    its size is fixed by ``bits`` whatever the number of hashes."""

    def places(batch: pa.RecordBatch) -> dict:
        values = batch.column("hash").to_numpy().view(np.uint64)
        at = np.unique(np.concatenate(bloom_probes(values, bits)))
        return {"word": at >> 6, "mask": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)}

    words = np.zeros(1 << (bits - 6), np.int64)
    rows = map_batches(seeds.select("hash"), places, "word long, mask long")
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most all words
    words[found["word"].to_numpy()] = found["mask"].to_numpy()
    return words.view(np.uint8)


def bloom_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The same filter with a truth value for each bit."""
    return np.unpackbits(packed_filter(seeds, bits), bitorder="little").astype(bool)


def _hits(maybe, bits: int, spans: list[int], reach: int, light: bool):
    """``maybe`` is a broadcast filter, eight bits a byte."""

    def find(batch: pa.RecordBatch) -> dict:
        filled = maybe.value
        out: dict[str, list] = {k: [] for k in ("doc_id", "begin", "tokens", "hashes", "places")}
        for doc, tokens in zip(batch.column("doc_id").to_pylist(), _tokens(batch.column("text"))):
            rows = [*seed_hashes(tokens, light=light), *(short_hashes(tokens, s) for s in spans)]
            values, places = [], []
            for row in rows:
                at = np.arange(len(row))
                for k in bloom_probes(row, bits) if len(row) else []:
                    k = k[at]
                    at = at[(filled[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)]
                values.append(row[at])
                places.append(at)
            places = np.concatenate([*places, np.zeros(0, np.int64)])
            if not len(places):
                continue
            values = np.concatenate(values)
            order = np.argsort(places, kind="stable")
            places, values = places[order], values[order]
            # Hits close to each other travel with one piece of the text.
            for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > 2 * reach) + 1):
                begin = max(0, int(places[part[0]]) - reach)
                end = int(places[part[-1]]) + SPAN + reach
                out["doc_id"].append(doc)
                out["begin"].append(begin)
                out["tokens"].append(tokens[begin:end].view(np.int64))
                out["hashes"].append(values[part].view(np.int64))
                out["places"].append(places[part])
        return out

    return find


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """``(matches, begin, end)`` of the run with the highest score, where a match
    counts 1 and a substitution -PENALTY; the first of equal ones."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    gain = sums - np.minimum.accumulate(sums)
    end = int(np.argmax(gain))
    if not gain[end]:
        return 0, 0, 0
    begin = int(np.flatnonzero(sums[: end + 1] == sums[: end + 1].min())[-1])
    return int(same[begin:end].sum()), begin, end


def _verify(matches: int):
    def check(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "matched", "first_token", "run")}
        for doc, begin, tokens, item, sequence, shift in zip(
            *(batch.column(c).to_pylist() for c in ("doc_id", "begin", "tokens", "item_id", "sequence", "shift"))
        ):
            # Token p of the piece faces token p - shift of the item.
            low, high = max(0, shift), min(len(tokens), shift + len(sequence))
            same = np.array(tokens[low:high]) == np.array(sequence[low - shift : high - shift])
            found, a, b = best_run(same)
            if found >= min(matches, len(sequence)):
                out["doc_id"].append(doc)
                out["item_id"].append(item)
                out["matched"].append(found)
                out["first_token"].append(begin + low + a)
                out["run"].append(b - a)
        return out

    return check


def _sequences(batch: pa.RecordBatch) -> dict:
    return {
        "item_id": batch.column("item_id"),
        "sequence": [t.view(np.int64) for t in _tokens(batch.column("text"))],
    }


def contaminated(docs: DataFrame, benchmark: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Benchmark items found in texts: doc_id, item_id, matched (tokens that agree along
    the best run), first_token (where it begins in the text), n_hits (diagonals that
    reach the threshold). One row per document and item, none for clean documents.

    ``benchmark`` has item_id and text. Tokens are runs of letters, digits and other
    scripts, A-Z lower-cased. Items of fewer tokens than ``matches`` have to occur
    whole. Null or empty texts, and rows without an id, find nothing. Rows that share a
    doc_id are one document; one that is repeated counts once.

    With one token in ten substituted at random, of items of 10, 11, 12, 15, 20, 25 and 40
    tokens that still reach the threshold (``matches`` along a run) all are found in a test
    with 400 of each, but for a few longer ones that the test bounds at one in a hundred.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("doc_id is not null")
    items = benchmark.selectExpr("cast(item_id as long) as item_id", "text").where("item_id is not null")
    items = items.dropDuplicates()
    seeds = store(
        map_batches(items, _bench, "item_id long, hash long, place int, tokens int"), "spaced-seeds"
    )
    light = f"tokens >= {SPAN} and tokens < {LONG}"
    total, longest, short_items = seeds.agg(F.count("*"), F.max("tokens"), F.count_if(F.expr(light))).first()
    short = [r[0] for r in seeds.where(f"tokens < {SPAN}").select("tokens").distinct().collect()]
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) * 64)), 16, FILTER_BITS))
    maybe = docs.sparkSession.sparkContext.broadcast(packed_filter(seeds, bits))  # 32 MB at most
    hits = store(
        map_batches(
            docs, _hits(maybe, bits, sorted(short), longest or 0, short_items > 0),
            "doc_id long, begin int, tokens array<long>, hashes array<long>, places array<int>",
        ),
        "spaced-hits",
    )
    shifts = (
        hits.selectExpr("doc_id", "begin", "explode(arrays_zip(hashes, places)) as h")
        .selectExpr("doc_id", "begin", "h.hashes as hash", "h.places - begin as at")
        .join(seeds, "hash")
        .selectExpr("doc_id", "begin", "item_id", "at - place as shift").distinct()
    )
    sequences = map_batches(items, _sequences, "item_id long, sequence array<long>")
    facing = shifts.join(sequences, "item_id").join(
        hits.select("doc_id", "begin", "tokens").distinct(), ["doc_id", "begin"]
    ).select("doc_id", "begin", "tokens", "item_id", "sequence", "shift")
    found = map_batches(
        facing, _verify(matches), "doc_id long, item_id long, matched int, first_token int, run int"
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"),
        F.expr("max_by(first_token, struct(matched, -first_token))").alias("first_token"),
        F.count("*").alias("n_hits"),
    )
