"""Runs of periodically repeated words, found through multi-scale minimizers.

A run is a stretch of words with smallest period q, at least ``least`` words and at least
``repeats`` periods long, that no neighbouring word extends.

At scale s (16, 32, 64 ... words) grams of s words are hashed, and windows of s / 2 places
choose the place of their smallest hash. Inside a run whose period q is at least s and
below 2 s, a window and the one q words later hold the same grams, so their choices are
two equal grams q words apart: a seed. Seeds are extended word by word to the whole
stretch that keeps the period. A window in which the smallest hash comes twice chooses
nothing. Nothing is lost by it: equal grams less than s / 2 apart mean a stretch of that
shorter period, and were all windows of the run such, their stretches would overlap by
more than two periods, so that the shorter period would hold throughout. For the same
reason equal choices are sparse: a place has only a few partners at a scale, and constant
or short-period stretches have none. Periods below the first scale are found by comparing
words a lag apart, one sample of words for every block that a long enough streak contains.

All of it runs on arrays of word numbers, for many texts at once, each ended by a number
of its own; time and memory grow as the words times the number of scales.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches

LEAST = 24  # words of a run
REPEATS = 3  # periods of a run; the search needs three at least
SCALE = 16  # words of the first scale's grams; shorter periods are compared directly
WORDS_AT_ONCE = 1 << 18  # words of texts that are searched together

Run = tuple[int, int, int]  # start, length, period


def find_runs(texts: list[np.ndarray], least: int = LEAST, repeats: int = REPEATS) -> list[list[Run]]:
    """The runs of each text, a text being an array of word numbers from 0 on; ordered by
    start, then period."""
    if repeats < 3:
        raise ValueError("the search needs three periods or more")
    found: list[set[Run]] = [set() for _ in texts]
    for numbers in _together(texts, least):
        _search(numbers, texts, found, range(1, SCALE), least, repeats)
    scale, longest = SCALE, max(map(len, texts), default=0)
    while repeats * scale <= longest:
        for numbers in _together(texts, max(least, repeats * scale)):
            _search(numbers, texts, found, scale, least, repeats)
        scale *= 2
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def _together(texts: list[np.ndarray], at_least: int) -> Iterator[list[int]]:
    """Numbers of the texts that are long enough, in groups of bounded size."""
    group, size = [], 0
    for number, text in enumerate(texts):
        if len(text) >= at_least:
            if size and size + len(text) > WORDS_AT_ONCE:
                yield group
                group, size = [], 0
            group.append(number)
            size += len(text)
    if group:
        yield group


def _search(numbers: list[int], texts: list, found: list, where: range | int, least: int, repeats: int) -> None:
    """Runs of the texts ``numbers``: of the lags ``where``, or of the scale ``where``."""
    parts, starts, at = [], [], 0
    for k, number in enumerate(numbers):
        parts += [texts[number], [-1 - k]]
        starts.append(at)
        at += len(texts[number]) + 1
    words = np.concatenate(parts).astype(np.int64)
    bounds = np.array(starts)
    lags = (_seeds(words, where).items() if isinstance(where, int) else
            ((lag, _streaks(words, lag, max(least - lag, (repeats - 1) * lag))) for lag in where))
    for lag, seeds in lags:
        done = -1
        for seed in seeds.tolist():
            if seed < done:
                continue  # inside the stretch found last
            start, done = _stretch(words, seed, lag)
            length = done - start + lag
            if length >= max(least, repeats * lag) and _smallest(words, start, lag):
                k = int(np.searchsorted(bounds, start, "right")) - 1
                found[numbers[k]].add((start - starts[k], length, lag))


def _streaks(words: np.ndarray, lag: int, need: int) -> np.ndarray:
    """A place of every streak of ``need`` words that are equal to those ``lag`` later: it
    holds a whole block of half that size, of which the first words are compared first."""
    block = (need + 1) // 2
    at = np.arange(0, len(words) - lag - block + 1, block)
    for step in range(block):
        if not len(at):
            break
        at = at[words[at + step] == words[at + step + lag]]
    return at


def _seeds(words: np.ndarray, scale: int) -> dict[int, np.ndarray]:
    """Places by lag of equal minimizers at least ``scale`` and below twice as far apart."""
    places, grams = _minimizers(words, scale)
    order = np.argsort(grams, kind="stable")
    places, grams = places[order], grams[order]
    pairs, step = [], 1
    at = np.arange(len(places) - 1)
    while len(at):
        same = grams[at] == grams[at + step]
        apart = places[at + step] - places[at]
        near = same & (apart < 2 * scale)
        hit = near & (apart >= scale)
        pairs.append(np.stack([apart[hit], places[at[hit]]]))
        step += 1
        at = at[near]
        at = at[at + step < len(places)]
    found = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    found = found[:, np.lexsort((found[1], found[0]))]
    lags, first = np.unique(found[0], return_index=True)
    return dict(zip(lags.tolist(), np.split(found[1], first[1:])))


def _minimizers(words: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of grams that are the only smallest of a window."""
    hashes = _mixed(words.view(np.uint64))
    size = 1
    while size < scale:
        hashes = _mixed(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])
        size *= 2
    half = scale // 2
    if len(hashes) < half:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    place = np.arange(len(hashes), dtype=np.uint64)
    first = _least(hashes & ~low | place, half) & low
    last = low - (_least(hashes & ~low | low - place, half) & low)
    first = first[first == last]
    at = first[np.diff(first, prepend=first[:1] + np.uint64(1)) != 0].astype(np.int64)
    return at, hashes[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(27)


def _least(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest of every ``window`` neighbours, a power of two, by doubling."""
    size = 1
    while size < window:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values


def _stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The streak around ``at`` of words equal to those ``lag`` later: its start and end.
    If they differ at ``at`` itself, it is empty and ends behind ``at``."""
    end, size, stop = at, 64, len(words) - lag
    while end < stop:
        until = min(end + size, stop)
        wrong = np.flatnonzero(words[end:until] != words[end + lag : until + lag])
        if len(wrong):
            end += int(wrong[0])
            break
        end, size = until, size * 2
    if end == at:
        return at + 1, at + 1
    start, size = at, 64
    while start > 0:
        until = max(start - size, 0)
        wrong = np.flatnonzero(words[until:start] != words[until + lag : start + lag])
        if len(wrong):
            start = until + int(wrong[-1]) + 1
            break
        start, size = until, size * 2
    return start, end


def _smallest(words: np.ndarray, start: int, lag: int) -> bool:
    """Is ``lag`` the smallest period? With three periods, a smaller one divides it."""
    rest, prime = lag, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            shorter = lag // prime
            if np.array_equal(words[start : start + lag], words[start + shorter : start + shorter + lag]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def kept_words(size: int, runs: list[Run]) -> np.ndarray:
    """Which of ``size`` words stay if every run is cut down to its first period."""
    depth = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def most_periods(runs: list[Run]) -> Run | None:
    """The run with the most periods; ties go to the smaller start, then period."""
    best = None
    for run in runs:  # ordered by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def repeated_runs(
    docs: DataFrame, least: int = LEAST, repeats: int = REPEATS, columns: str = "digests"
) -> DataFrame:
    """The runs of every whole text of ``docs``; words are parted by ASCII white space.

    Returns one row per row of ``docs``, repeated ones too: doc_id, n_runs; start, length,
    period and exponent_milli (floor of 1000 length / period) of the run with the most
    periods, null without runs; runs_sha256 of all runs' ``start,length,period`` lines;
    collapsed_sha256 of the text with every run cut down to its first period, words joined
    by one space. With ``columns="all"`` also runs (array of structs) and collapsed.
    Null and empty texts have no words, no runs, and the digests of the empty text.
    """

    def run(batch: pa.RecordBatch) -> dict:
        number = _Numbers()
        texts = [(t or "").encode().split() for t in batch.column("text").to_pylist()]
        coded = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
        found = find_runs(coded, least, repeats)
        out: dict[str, list] = {c: [] for c in NAMES}
        for words, runs in zip(texts, found):
            best = most_periods(runs)
            if runs:
                words = np.array(words, object)[kept_words(len(words), runs)].tolist()
            collapsed = b" ".join(words)
            start, length, period = best or (None, None, None)
            lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            values = (len(runs), start, length, period, best and 1000 * length // period,
                      hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
            for name, value in zip(NAMES, values):
                out[name].append(value)
            if columns == "all":
                out.setdefault("runs", []).append([dict(zip(("start", "length", "period"), r)) for r in runs])
                out.setdefault("collapsed", []).append(collapsed.decode())
        if columns == "all":
            out["runs"] = pa.array(out["runs"], RUNS)
        return {"doc_id": batch.column("doc_id"), **out}

    kinds = KINDS
    if columns == "all":
        kinds += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, kinds)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
KINDS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where about every tenth document, chosen by the CRC of
    its doc_id, repeats its words from some place on; place and period come from the CRC.
    With h the CRC, g = floor(h / 10) and n words: if 10 divides h, each word i from
    a = g mod n on becomes word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)).
    Rows without doc_id, and texts without words, stay as they are."""
    crc = F.expr("crc32(cast(cast(doc_id as string) as binary))")
    tail = "case when i < a then w else element_at(words, cast(a + (i - a) % p + 1 as int)) end"
    marked = docs.selectExpr("cast(doc_id as long) as doc_id", "text").withColumn("h", crc)
    words = r"case when h % 10 = 0 then regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) end as words"
    return (
        marked.selectExpr("doc_id", "text", "floor(h / 10) as g", words)
        .selectExpr("*", "cast(size(words) as long) as n")
        .selectExpr("*", "case when n > 0 then g % n end as a")
        .selectExpr("*", "1 + floor((n - a) / (3 + g % 8)) as p")
        .selectExpr("doc_id", f"case when n > 0 then array_join(transform(words, (w, i) -> {tail}), ' ') else text end as text")
    )
