"""SentencePiece encoding that keeps offsets, and decoding, with BPE piece models.

A text is normalised by the longest prefix that the model's compiled character map
knows, again and again; every byte written notes the byte of the text it stems from.
Pieces tile the normalised bytes, so these notes project each piece to its span of
original bytes. As in the library, an unknown character becomes byte pieces, of which the
last holds the whole span and the others are empty.

Merging takes the pair with the best score first, then the leftmost. Where no piece of
the vocabulary crosses from one kind of character to another, merges cannot either, and
the text is merged segment by segment; workers remember a bounded number of segments.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

SPACE = "▁"  # stands for a space inside pieces
SEGMENTS_KEPT = 600_000  # merged segments that one worker remembers
LONGEST_KEPT = 40  # longer segments hardly come again
SHORT = 24  # up to so many symbols, a scan finds the best pair sooner than a queue


class Segmenter:
    """Cuts normalised texts into letters, single digits and runs of other characters,
    each with the spaces before them; ``others`` are letters that count as other."""

    def __init__(self, others: str = ""):
        letter, other = f"[^\\W\\d_{others}]", f"(?![{SPACE}0-9])[\\W\\d_{others}]"
        self.letter = re.compile(letter)
        self.cut = re.compile(f"{SPACE}*(?:{letter}+|[0-9]|(?:{other})+)|{SPACE}+").findall

    def crosses(self, piece: str) -> bool:
        """Is there a pair of neighbours in ``piece`` between which a text may be cut?"""
        kinds = [
            "S" if c == SPACE else "D" if c in "0123456789" else "L" if self.letter.match(c) else "O" for c in piece
        ]
        return any(b == "S" != a or a == "D" or a != b and a != "S" for a, b in zip(kinds, kinds[1:]))

    @classmethod
    def of(cls, pieces: list[str]) -> Segmenter | None:
        """One whose cuts no piece spans. Numbers such as superscripts count as word
        characters; those in pieces that a first one would cut join the others."""
        plain = cls()
        numbers = {c for p in pieces if plain.crosses(p) for c in p if c.isnumeric() and not c.isalpha()}
        made = cls("".join(sorted(numbers - set("0123456789"))))
        return None if any(map(made.crosses, pieces)) else made


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes, whose values are
    places in a block of replacement texts, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.texts = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``text[at:]`` in the map, and what replaces it."""
        units = self.units
        node, found = _offset(units[0]), None
        for end in range(at, len(text)):
            node ^= text[end]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != text[end]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


class Normalizer:
    """What a model's normaliser specification asks for, with source offsets."""

    def __init__(self, spec, spaces_after: bool = False):
        if not spec.escape_whitespaces or spaces_after:
            raise ValueError("only models that mark spaces before words are read")
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.plain = self.map is None and not self.squeeze

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text in UTF-8, and for each of its bytes and its end the byte
        of ``text`` (in UTF-8) it stems from."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            times = np.where(np.frombuffer(raw, np.uint8) == 32, 3, 1)
            lead = np.zeros(3 * self.prefix, np.int64)
            source = np.concatenate([lead, np.repeat(np.arange(len(raw)), times), [len(raw)]])
            return self.text(text).encode(), source
        return self._mapped(raw)

    def text(self, text: str) -> str:
        """The normalised text alone."""
        if self.plain:
            return (" " * self.prefix + text).replace(" ", SPACE) if text else ""
        return self(text)[0].decode()

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        parts, at = [], 0
        while at < len(raw):
            length, new = self._step(raw, at)
            parts.append((at, new))
            at += length
        if self.squeeze:
            while parts and parts[0][1] == b" ":
                del parts[0]
        if not parts:
            return b"", np.zeros(1, np.int64)
        mark = SPACE.encode()
        out, source = bytearray(), []
        if self.prefix:
            out += mark
            source += [parts[0][0]] * len(mark)
        after_space, ends = self.squeeze, len(raw)
        for at, new in parts:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                after_space = self.squeeze and new.endswith(b" ")
                new = new.replace(b" ", mark)
                out += new
                source += [at] * len(new)
        if self.squeeze:
            while out.endswith(mark):
                ends = source[-len(mark)]
                del out[-len(mark) :], source[-len(mark) :]
        return bytes(out), np.array([*source, ends])

    def _step(self, raw: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(raw, at) if self.map else None
        if found:
            return found
        lead = raw[at]
        length = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return length, raw[at : at + length]


class _Segments(dict):
    """segment -> its ids as bytes; a miss is merged, and kept up to a bound."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.older = merge, {}

    def __missing__(self, segment: str) -> bytes:
        ids = self.older.get(segment)
        if ids is None:
            ids = array("i", self.merge(segment)).tobytes()
        if len(segment) <= LONGEST_KEPT:
            if len(self) >= SEGMENTS_KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids


class PieceModel:
    """Reads a BPE piece model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece.sentencepiece_model_pb2 import ModelProto, TrainerSpec

        proto = ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trainer, kind = proto.trainer_spec, ModelProto.SentencePiece
        special = {p.type for p in proto.pieces} & {kind.USER_DEFINED, kind.UNUSED}
        if trainer.model_type != TrainerSpec.BPE or not trainer.byte_fallback or special:
            raise ValueError("only BPE models with byte fallback and plain pieces are read")
        self.normalize = Normalizer(proto.normalizer_spec, trainer.treat_whitespace_as_suffix)
        self.pieces = [p.piece for p in proto.pieces]
        plain = [(i, p) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL]
        self.ids = {p.piece: i for i, p in plain}
        # A smaller rank merges first; equal scores share a rank.
        order = {s: r for r, s in enumerate(sorted({p.score for _, p in plain}, reverse=True))}
        self.ranks = {p.piece: order[p.score] for _, p in plain}
        self.byte_ids = [0] * 256
        self.surfaces = [p.piece.replace(SPACE, " ").encode() for p in proto.pieces]
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kind.CONTROL}
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN}
        self.is_byte = np.zeros(len(self.pieces), bool)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value], self.is_byte[i], self.surfaces[i] = i, True, bytes([value])
            elif i in self.control:
                self.surfaces[i] = b""
            elif i in self.unknown:
                self.surfaces[i] = trainer.unk_surface.encode()
        self.special = np.isin(np.arange(len(self.pieces)), [*self.control, *self.unknown])
        self.lengths = np.array([1 if b else len(p.encode()) for p, b in zip(self.pieces, self.is_byte)])
        # Without a segmenter every text is merged as a whole.
        self.segmenter = Segmenter.of(list(self.ids))
        self.known = _Segments(self.merge)

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        parts = self._scan(list(text)) if len(text) <= SHORT else self._queue(text)
        ids = self.ids
        try:
            return [ids[p] for p in parts]
        except KeyError:
            found = []
        for part in parts:
            one = ids.get(part)
            if one is None:
                found += [self.byte_ids[b] for b in part.encode()]
            else:
                found.append(one)
        return found

    def _scan(self, parts: list[str]) -> list[str]:
        rank, never = self.ranks.get, 1 << 40
        waiting = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while waiting:
            best = min(waiting)
            if best == never:
                break
            i = waiting.index(best)
            part = parts[i] = parts[i] + parts.pop(i + 1)
            del waiting[i]
            if i:
                waiting[i - 1] = rank(parts[i - 1] + part, never)
            if i < len(waiting):
                waiting[i] = rank(part + parts[i + 1], never)
        return parts

    def _queue(self, text: str) -> list[str]:
        parts: list[str] = list(text)
        n, ranks = len(parts), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []

        def offer(i: int, j: int) -> None:
            rank = ranks.get(parts[i] + parts[j])
            if rank is not None:
                heapq.heappush(queue, (rank, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has changed since
            parts[i] += parts[j]
            parts[j] = ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def ids_of(self, normal: str) -> np.ndarray:
        """Ids of a normalised text, through the segments that workers remember."""
        segments = self.segmenter.cut(normal) if self.segmenter else [normal] if normal else []
        return np.frombuffer(b"".join(map(self.known.__getitem__, segments)), np.int32)

    def spans(self, ids: np.ndarray, normal: bytes, source: np.ndarray) -> np.ndarray:
        """(start, end) of each piece in the bytes of the text."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        found = np.stack([source[starts], source[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)
        single = self.is_byte[ids]
        if single.any():
            raw = np.frombuffer(normal, np.uint8)
            place = np.arange(len(raw) + 1)
            begins = np.append(raw & 0xC0 != 0x80, True)
            head = np.maximum.accumulate(np.where(begins, place, 0))
            at = starts[single]
            begin = source[head[at]]
            found[single] = np.stack([begin, np.where(begins[at + 1], source[at + 1], begin)], axis=1)
        return found

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text and the (start, end) of each in its UTF-8 bytes."""
        normal, source = self.normalize(text)
        ids = self.ids_of(normal.decode())
        return ids, self.spans(ids, normal, source)

    def decode(self, ids) -> str:
        """Surfaces joined: marks are spaces, without the one that normalisation put first;
        runs of byte pieces are read as UTF-8, and each byte that is not part of a
        character becomes U+FFFD."""
        ids = np.asarray(ids, np.int32)
        special = self.special[ids].any()
        ids = ids.tolist()
        first = next((i for i in ids if i not in self.control), None)
        lead = self.normalize.prefix or self.normalize.squeeze
        strip = lead and first is not None and not self.is_byte[first] and self.pieces[first].startswith(SPACE)
        skip = 1 if strip else 0
        if not special:  # nothing is left out, so no two runs of byte pieces meet
            try:
                return b"".join(map(self.surfaces.__getitem__, ids))[skip:].decode()
            except UnicodeDecodeError:
                pass
        return self._mended(ids)[skip:]

    def _mended(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.surfaces[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                del run[:size]
            if i is not None:
                out.append(self.surfaces[i].decode())
        return "".join(out)


@functools.cache
def piece_model(path: str) -> PieceModel:
    """One for each worker process."""
    return PieceModel(path)


@functools.cache
def decimals(size: int, end: str) -> np.ndarray:
    """The decimal of each number below ``size``, followed by ``end``, padded with zero
    bytes; rows that are gathered and rid of zero bytes give a joined list at once."""
    return np.array([f"{i}{end}".encode() for i in range(size)])


def encode_pieces(docs: DataFrame, path: str, columns: str = "digests") -> DataFrame:
    """Every whole text of ``docs`` as pieces with spans, and decoded again.

    ``path`` is a model file that every machine has. Returns one row per row of ``docs``,
    repeated ones too: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256, spans_sha256 (of start and end of all pieces in turn, as little-endian
    32-bit numbers), and with ``columns="all"`` also ids, starts, ends (arrays) and decoded.
    Null texts count as empty: no pieces, decoded to the empty text.
    """

    def run(batch: pa.RecordBatch) -> dict:
        model = piece_model(path)
        table = decimals(len(model.pieces), ",")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        names = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "ids", "starts", "ends", "decoded")
        out: dict[str, list] = {c: [] for c in names}
        for text in batch.column("text").to_pylist():
            ids, spans = model.encode(text or "")
            decoded = model.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(sha(table[ids].tobytes().translate(None, b"\0")[:-1]))
            out["decoded_sha256"].append(sha(decoded.encode()))
            out["spans_sha256"].append(sha(spans.astype("<i4").tobytes()))
            if columns == "all":
                out["ids"].append(ids)
                out["starts"].append(spans[:, 0])
                out["ends"].append(spans[:, 1])
                out["decoded"].append(decoded)
        return {"doc_id": batch.column("doc_id"), **out}

    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    if columns == "all":
        kinds += ", ids array<int>, starts array<int>, ends array<int>, decoded string"
    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, kinds)
