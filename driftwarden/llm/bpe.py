"""BPE encoding and decoding with the files of public tokenizers.

A word is merged with a priority queue: pairs of neighbouring symbols wait in a heap by
merge rank and place, symbols form a doubly linked list, and entries whose symbols have
changed meanwhile are skipped when they come up. Decoding concatenates vocabulary
strings. Words repeat, so each worker keeps a bounded table of words it has merged.

Implements the parts that a word-level BPE file names: NFC, white space replaced,
lower case, a splitting pattern whose matches are the words, byte-level symbols, an
end-of-word suffix, and special tokens that are cut out of the text first.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import operator
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

WORDS_KEPT = 400_000  # merged words that one worker remembers


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, otherwise the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge ranks and the queue that applies them; symbols are their ids."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        self.vocabulary = vocabulary
        self.strings = {i: t for t, i in vocabulary.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {
            vocabulary[a] << 32 | vocabulary[b]: (rank, vocabulary[a + b])
            for rank, (a, b) in enumerate(pairs)
        }
        symbols = byte_symbols()
        self.inner = [vocabulary.get(c) for c in symbols]
        self.final = [vocabulary.get(c + suffix) for c in symbols]

    def split(self, word: bytes) -> list[int]:
        """The ids of one word's merged symbols; bytes without an id are left out."""
        parts = [self.inner[b] for b in word[:-1]]
        parts += [self.final[b] for b in word[-1:]]
        if None in parts:
            parts = [p for p in parts if p is not None]
        n, ranks = len(parts), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            merge = ranks.get(parts[i] << 32 | parts[i + 1])
            if merge is not None:
                queue.append(merge[0] << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if parts[i] < 0 or j < 0:
                continue  # stale: the symbol is gone
            merge = ranks.get(parts[i] << 32 | parts[j])
            if merge is None or merge[0] != entry >> 32:
                continue  # stale: it is another pair by now
            symbol = parts[i] = merge[1]
            parts[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                merge = ranks.get(symbol << 32 | parts[k])
                if merge is not None:
                    heapq.heappush(queue, merge[0] << 32 | i)
            h = before[i]
            if h >= 0:
                merge = ranks.get(parts[h] << 32 | symbol)
                if merge is not None:
                    heapq.heappush(queue, merge[0] << 32 | h)
        return [p for p in parts if p >= 0]


class _Words(dict):
    """word -> (ids joined, tokens joined); a miss is merged and kept up to a bound."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.split, self.strings = merges.split, merges.strings
        self.older: dict = {}  # what was kept before; words met again come back from it

    def __missing__(self, word: str) -> tuple[str, str]:
        entry = self.older.get(word)
        if entry is None:
            ids = self.split(word.encode())
            strings = self.strings
            entry = " ".join(map(str, ids)), " ".join([strings[i] for i in ids])
        if len(self) >= WORDS_KEPT // 2:
            self.older = dict(self)
            self.clear()
        self[word] = entry
        return entry


class Tokenizer:
    """Reads a tokenizer file with a word-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        self.cut = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")"
        )
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.known = _Words(self.merges)

    def normalize(self, text: str) -> str:
        """White space is not replaced, since no word holds any. Lower case goes letter
        by letter: a final sigma is not special."""
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def joined(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by a space, and the decoded text."""
        found: list[tuple[str, str]] = []
        for piece in self.cut.split(text) if "<|" in text else [text]:
            if piece in self.special:
                found.append((str(self.special[piece]), piece))
            else:
                found += map(self.known.__getitem__, self.words.findall(self.normalize(piece)))
        return " ".join(filter(None, map(_IDS, found))), " ".join(filter(None, map(_TEXT, found)))

    def encode(self, text: str) -> list[int]:
        ids = self.joined(text)[0]
        return [int(i) for i in ids.split(" ")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


_IDS, _TEXT = operator.itemgetter(0), operator.itemgetter(1)


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    """One for each worker process."""
    return Tokenizer(path)


def encode_texts(docs: DataFrame, path: str, columns: str = "ids") -> DataFrame:
    """Every whole text of ``docs`` as token ids and decoded again.

    ``path`` is a tokenizer file that every machine has. Returns one row per row of
    ``docs``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256, and with ``columns="all"`` also ids (array of int) and decoded.
    Null texts count as empty: no tokens, decoded to the empty text.
    """

    def run(batch: pa.RecordBatch) -> dict:
        coder = tokenizer(path)
        pairs = [coder.joined(t or "") for t in batch.column("text").to_pylist()]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": [i.count(" ") + 1 if i else 0 for i, _ in pairs],
            "ids_sha256": [sha(i) for i, _ in pairs],
            "decoded_sha256": [sha(d) for _, d in pairs],
        }
        if columns == "all":
            out["ids"] = [[int(x) for x in i.split(" ")] if i else [] for i, _ in pairs]
            out["decoded"] = [d for _, d in pairs]
        return out

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if columns == "all":
        kinds += ", ids array<int>, decoded string"
    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, kinds)
