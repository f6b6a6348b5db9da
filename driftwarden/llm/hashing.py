"""Hashes of words and word shingles, computed on whole Arrow columns of texts.

A word is a maximal run of bytes other than white space (0x20, 0x09-0x0D), with
A-Z lower-cased and every other character kept. Hashes have 64 bits: a
polynomial over the bytes and a bijective mix, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # texts are worked on in runs of about this size

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Anything but ASCII letters, digits and bytes of other scripts.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_POWERS = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (SplitMix64's finalizer)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def multipliers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on the seed only."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE)], dtype=np.uint64)
    return _POWERS


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK_BYTES`` each, one text at least."""
    ends = np.cumsum(byte_lengths(texts))
    begin = 0
    while begin < len(ends):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        yield begin, end
        begin = end


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as bytes, and the bounds of each. Null is the empty text."""
    joined = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    values = joined.buffers()[2]
    raw = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(texts: pa.Array, breaks: np.ndarray = SPACE):
    """``(bytes, starts, ends, offsets)``: lower-cased bytes, byte spans of the
    words, and for each text the range of its words. Null is the empty text."""
    raw, bounds = raw_bytes(texts)
    inside = ~breaks[raw]
    first = np.ones(len(raw) + 1, dtype=bool)
    first[1:] = ~np.r_[inside, False][:-1]
    first[bounds] = True
    starts = np.flatnonzero(inside & first[:-1])
    last = np.ones(len(raw), dtype=bool)
    last[:-1] = ~inside[1:] | first[1:-1]
    ends = np.flatnonzero(inside & last) + 1
    return _LOWER[raw], starts, ends, np.searchsorted(starts, bounds)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each byte span."""
    return prefix_hashes(raw, starts, ends, ())[0]


def prefix_hashes(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of byte spans, and for each size which spans are longer and the hashes
    of their first bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64), [(np.zeros(0, bool), np.zeros(0, np.uint64)) for _ in sizes]
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    at = within + np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        terms = (raw[at].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[within]
        if not sizes:
            return mix(np.add.reduceat(terms, begins)), []
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        whole = mix(sums[begins + lengths] - sums[begins])
        parts = []
        for n in sizes:
            longer = lengths > n
            first = begins[longer]
            parts.append((longer, mix(mix(sums[first + n] - sums[first]) + np.uint64(n))))
    return whole, parts


def word_hashes(texts: pa.Array, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the range of its words."""
    raw, starts, ends, offsets = word_spans(texts, breaks)
    return span_hashes(raw, starts, ends), offsets


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the word sequences of a text, ``size`` words each; a shorter text
    is one sequence; no words, none. Repeated ones stay."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    factors = multipliers(size, 17)
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, np.uint64(n))
        for j in range(n):
            total = total + words[j : len(words) - n + 1 + j] * factors[j]
    return mix(total)
