"""Piece spans, token alignment and periodic runs against the libraries and plain versions."""

import bisect
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece

import cases
from driftwarden.llm import periodic_runs, piece_spans, token_alignment
from driftwarden.llm.queries import BYTES, PIECES, queries, tokenizer_path

ODD = {
    3000: None, 3001: "", 3002: " ", 3003: "  a  b ", 3004: "▁x▁", 3005: "\n\n a\tb", 3006: "日本語 梦😀😀 é é",
    3007: "<s> </s> <unk> <0x41> <|endoftext|>", 3008: "a" * 500, 3009: " " * 3000 + "b", 3010: "12 34.5 x_y __ ²³.²",
    3011: "\x00a\x00", 3012: "नमस्ते กำ", 3013: "x " * 3000, 3014: "ab cd " * 700 + "end",
}


@pytest.fixture(scope="module")
def rows():
    return cases.texts() | {r["doc_id"] + 10_000: r["text"] for r in cases.table("documents")} | ODD


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_and_spans_equal_the_library(spark, rows, library):
    got = piece_spans.encode_pieces(cases.documents(spark, rows), tokenizer_path(PIECES), columns="all").collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        want = library.encode(text, return_type="proto").pieces
        ids = [p.id for p in want]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert list(zip(r.starts, r.ends)) == [(p.begin, p.end) for p in want]
        assert r.decoded == library.decode(ids) and r.decoded_sha256 == sha(r.decoded)
        assert r.ids_sha256 == sha(",".join(map(str, ids)))


def test_decoding_any_ids_equals_the_library(library):
    model, draw = piece_spans.piece_model(tokenizer_path(PIECES)), random.Random(1)
    for _ in range(3000):
        ids = [
            draw.choice([draw.randrange(32_000), draw.randrange(3), draw.randrange(3, 259), draw.randrange(170, 259)])
            for _ in range(draw.randrange(12))
        ]
        assert model.decode(ids) == library.decode(ids)


def test_queue_and_scan_agree():
    model, draw = piece_spans.piece_model(tokenizer_path(PIECES)), random.Random(2)
    for _ in range(500):
        text = "".join(draw.choices("▁abethinr.,é梦1", k=draw.randrange(1, 40)))
        assert model._scan(list(text)) == model._queue(text)


def test_no_piece_spans_two_segments():
    model = piece_spans.piece_model(tokenizer_path(PIECES))
    assert model.segmenter.cut("▁▁ab²1²2..▁.c") == ["▁▁ab", "²", "1", "²", "2", "..", "▁.", "c"]
    assert piece_spans.Segmenter.of(["a▁b"]) is None and piece_spans.Segmenter.of(["a.b"]) is None


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisation_and_sources_equal_the_library(rule, prefix, squeeze):
    from sentencepiece.sentencepiece_model_pb2 import NormalizerSpec

    theirs = sentencepiece.SentencePieceNormalizer(
        rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True
    )
    spec = NormalizerSpec()
    spec.ParseFromString(theirs.serialized_normalizer_spec())
    own, draw = piece_spans.Normalizer(spec), random.Random(3)
    for _ in range(300):
        letters = "ab  ｶﾞ①Ａ…é　\t\n ﬁﾟ½Ⅷ한가̈" + chr(draw.randrange(32, 0x3000))
        text = "".join(draw.choices(letters, k=draw.randrange(1, 14)))
        normal, source = own(text)
        want, places = theirs.normalize(text, with_offsets=True)
        assert normal.decode() == want == own.text(text)
        begins = [i for i, b in enumerate(normal) if b & 0xC0 != 0x80] + [len(normal)]
        if normal:
            assert [len(text.encode()[: source[i]].decode()) for i in begins] == list(places)


def plain_alignment(text, coder, library, tokens_b):
    raw = (" " + (text or "")).encode()
    ids_a = coder.library.encode(raw.decode(), add_special_tokens=False).ids if text else []
    ids_b = library.encode(text) if text else []
    parts_a, parts_b = [coder.tokens[i] for i in ids_a], [tokens_b[i] for i in ids_b]
    if not text or b"".join(parts_a) != raw or b"".join(parts_b) != raw:
        return [], [], []
    ends_a, ends_b = (np.cumsum([len(p) for p in parts]).tolist() for parts in (parts_a, parts_b))
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = bisect.bisect(ends_a, end), bisect.bisect(ends_b, end)
        groups.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return ids_a, ids_b, groups


def test_alignment_equals_a_plain_version(spark, rows, library):
    rows = rows | {4000: "twice told", 4001: None}
    docs = cases.documents(spark, rows).union(cases.documents(spark, {4000: "twice told"}))
    paths = tokenizer_path(BYTES), tokenizer_path(PIECES)
    coder, pieces = token_alignment.coders(*paths)
    found = {i: plain_alignment(t, coder, library, pieces.tokens) for i, t in rows.items()}
    links = {i: collections.Counter((a, b) for g, h in x[2] for a in g for b in h) for i, x in found.items()}
    count = collections.Counter(p for i, c in links.items() for p in c for _ in range(2 if i == 4000 else 1))
    most = collections.defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    got = token_alignment.aligned_documents(docs, *paths).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        ids_a, ids_b, groups = found[r.doc_id]
        c = links[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(ids_a), len(ids_b), len(groups), sum(c.values()))
        assert r.count_sum == sum(n * count[p] for p, n in c.items())
        assert r.n_best == sum(n for p, n in c.items() if count[p] == most[p[0]])
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        assert r.groups_sha256 == (sha(text) if ids_a else "")


def test_rare_pairs_are_joined_to_the_same_sums(spark, rows):
    paths = tokenizer_path(BYTES), tokenizer_path(PIECES)
    docs = cases.documents(spark, dict(list(rows.items())[:60]))
    aligned = token_alignment.align_tokens(docs, *paths, columns="all").cache()
    first = aligned.where("n_links > 0").first()
    assert first.ends_a[-1] == first.n_a and first.ends_b[-1] == first.n_b and len(first.ends_a) == first.n_groups
    counts = token_alignment.pair_counts(aligned, 32_000).cache()
    every, few, none = (
        sorted(map(tuple, token_alignment.link_strengths(aligned, counts, common).collect()))
        for common in (1 << 20, 100, 0)
    )
    assert every == few == none


def test_galloping_finds_what_both_lists_hold():
    draw = np.random.default_rng(4)
    for _ in range(500):
        x = np.unique(draw.integers(0, draw.integers(1, 500), draw.integers(0, 300)))
        y = np.unique(draw.integers(0, draw.integers(1, 5000), draw.integers(0, 300)))
        i, j = token_alignment.shared(x, y)
        assert np.array_equal(x[i], np.intersect1d(x, y)) and np.array_equal(y[j], x[i])


def test_large_groups_go_by_distinct_ids():
    a, b = np.array([1, 2, 1, 2] * 200), np.array([5, 6, 5] * 200)
    ends = np.array([800]), np.array([600])
    found = collections.Counter()
    for _, keys, times in token_alignment.pairs_of(np.zeros(1, int), a, b, *ends, 10):
        for k, n in zip(keys.tolist(), times.tolist()):
            found[divmod(k, 10)] += n
    assert found == {(x, y): 400 * n for x in (1, 2) for y, n in ((5, 400), (6, 200))}


def plain_runs(words, least=24, repeats=3):
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if size >= max(least, repeats * q) and not any(
                words[start : start + size - d] == words[start + d : start + size] for d in range(1, q)
            ):
                found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def drawn_words(draw):
    letters, words = draw.choice([1, 2, 3, 5, 30]), []
    for _ in range(draw.randrange(6)):
        period = draw.choice([1, 2, 3, 5, 15, 16, 17, 20, 31, 32, 33, 48, 63, 64, 65, 70, 100])
        block = draw.choices(range(letters), k=period)
        if draw.random() < 0.4 and period > 3:  # a block with a shorter period but for one word
            short = draw.randrange(1, period)
            block = (block[:short] * period)[:period]
            block[draw.randrange(period)] = draw.randrange(letters)
        words += (block * 9)[: draw.randrange(period, int(period * 5.5) + 2)]
        words += draw.choices(range(letters), k=draw.randrange(30))
    return words[:600]


def test_runs_equal_brute_force():
    draw = random.Random(6)
    texts = [drawn_words(draw) for _ in range(300)]
    got = periodic_runs.find_runs([np.array(t, np.int64) for t in texts])
    assert sum(map(len, got)) > 200
    for words, runs in zip(texts, got):
        assert runs == plain_runs(words)
    with pytest.raises(ValueError):
        periodic_runs.find_runs([], repeats=2)


def test_long_periodic_texts_take_seconds():
    n = 300_000
    for words in (np.zeros(n, np.int64), np.arange(n) % 20, np.arange(n) % 1000):
        assert [r[:2] for r in periodic_runs.find_runs([words])[0]] == [(0, n)]


def tailed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_periodic_runs_of_documents(spark, rows):
    docs = cases.documents(spark, rows).union(cases.documents(spark, {ODD_ID: rows[ODD_ID]}))
    got = periodic_runs.repeated_runs(periodic_runs.with_periodic_tails(docs), columns="all").collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if len(rows[r.doc_id] or "") > 5_000 and r.doc_id != 3014:
            continue  # too long for the plain version
        words = tailed(r.doc_id, (rows[r.doc_id] or "").encode().split())
        runs = plain_runs(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs and r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])


ODD_ID = 3014


def test_rows_without_doc_id_keep_their_text(spark):
    docs = spark.createDataFrame([(None, "a  b"), (None, None)], "doc_id long, text string")
    assert [r.text for r in periodic_runs.with_periodic_tails(docs).collect()] == ["a  b", None]


@pytest.mark.parametrize("name", ["op11_token_alignment", "op12_periodic_runs", "op13_piece_spans"])
def test_empty_tables(spark, tmp_path, name):
    cases.documents(spark, {}).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()[name](spark, str(tmp_path)).collect() == []


def test_both_libraries_cut_every_code_point_alike():
    coder, _ = token_alignment.coders(tokenizer_path(BYTES), tokenizer_path(PIECES))
    assert coder.fast is not None
    for begin in range(0, 0x110000, 512):
        letters = [chr(c) for c in range(begin, begin + 512) if not 0xD800 <= c < 0xE000]
        text = "".join(f" a{x}b {x}1{x}. {x}{x}" for x in letters)
        assert coder.encode(text).tolist() == coder.library.encode(text, add_special_tokens=False).ids, hex(begin)
    blanks = "a" + " " * 5000 + "\n" * 3000 + "b"  # more than the faster one's pattern takes
    assert coder.encode(blanks).tolist() == coder.library.encode(blanks, add_special_tokens=False).ids
