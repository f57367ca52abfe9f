"""Exact operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditjobs.llm import bit_sliced, byte_bpe, exact_dedup, packing, queries

BYTE, WORD = queries.BYTE_RANKS, queries.WORD_BPE
CLASH = "rid long, body string, name string, n string"

TEXTS = [
    (1, "the cat sat on the mat"), (2, None), (3, ""), (4, "   \n\t"), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"),
    (6, "naïve 東京 \U0001f600 é <|endoftext|> it's 12345  x"), (None, "no id"), (8, "word " * 9000), (9, "\x00 nul \x1c"),
]


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, 7, "b", "n", "m") for i, t in rows], f"doc_id long, text string, {CLASH}")


def test_dedup(spark):
    for size, print_of in ((4096, F.xxhash64), (3, F.xxhash64), (3, lambda c: F.length(c).cast("long"))):
        found = exact_dedup.exact_dedup(table(spark), block_bytes=size, fingerprint=print_of).collect()
        assert len(found) == len(TEXTS)
        groups = {}
        for i, t in TEXTS:
            groups.setdefault(t or "", []).append(i)
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in found:
            ids = by_hash[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max(ids, key=lambda i: (i is not None, i)) and r.doc_id in ids
        assert sum(r.kept for r in found) == len(groups)
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


def test_byte_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    with open(BYTE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    letters = [*map(chr, range(32, 127)), "\n", " ", "é", "中", "\U0001f600", "̀", " the", "  ", "'s"]
    rows = TEXTS + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for i in range(200)]
    got = byte_bpe.encode(table(spark, rows), BYTE, public_tokenizers.PATTERN, offsets=True)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in got.collect()) == sorted((i or 0, tuple(own.encode_ordinary(t or ""))) for i, t in rows)
    back = byte_bpe.decode(got, BYTE, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t in rows)
    emoji = got.filter("doc_id = 6").first()
    assert all(0 <= a <= b <= len(TEXTS[6][1]) for a, b in zip(emoji.starts, emoji.ends))
    # a cut inside a character gives the replacement character, not an error
    cut = spark.createDataFrame([(1, own.encode_ordinary("\U0001f600")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in byte_bpe.decode(cut, BYTE, public_tokenizers.PATTERN).collect()} == {1: "�", 2: ""}
    for r in byte_bpe.round_trip_digests(table(spark, rows), BYTE, public_tokenizers.PATTERN).filter("doc_id >= 100").collect():
        text = rows[len(TEXTS) + r.doc_id - 100][1]
        ids = np.array(own.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.encode(table(spark, []), BYTE, public_tokenizers.PATTERN).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD)
    for capacity in (64, 4096):
        got = packing.pack(table(spark), WORD, capacity).collect()
        ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in TEXTS]
        expected = []
        for (i, _), x in zip(TEXTS, ids):
            for k in range(0, len(x), capacity):
                part = np.array(x[k : k + capacity], "<u4")
                expected.append((i or 0, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
        assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
        used = {}
        for r in got:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in used.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(used) <= sum(e[3] for e in expected) / capacity + 2
    assert packing.pack(table(spark, []), WORD).count() == 0


def test_words_are_encoded_as_in_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(7)
    letters = [*map(chr, range(32, 127)), "\n", "\t", "\u0085", " ", " ", "é", "Σ", "İ", "ß", "́", "ᄀ", "ᅡ", "中", "The ", "it's", ", ", ". "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(500)]
    whole = Tokenizer.from_file(WORD)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in packing.encode_words(texts, WORD)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_equals_one_by_one(seed):
    import bisect

    rng = random.Random(seed)
    histogram = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 101), 40)}
    gaps, opened = [], 0
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            k = bisect.bisect_left(gaps, n)
            gap = gaps.pop(k) if k < len(gaps) else 100
            opened += gap == 100
            bisect.insort(gaps, gap - n)
    steps = packing.best_fit(histogram, 100)
    assert max(first - (a - b) // each for _, a, b, first, each, _ in steps) == opened
    assert sum(b - a for _, a, b, *_ in steps) == sum(histogram.values())


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=8).astype(float).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 340)]  # ties
    rows += [(340, None), (341, [1.0, None] * 4), (342, [float("nan")] * 8), (343, [float("inf")] * 8), (344, []), (346, []), (340, []), (345, [1.0, 2.0]), (20, [0.5] * 8), (None, [0.5] * 8), (360, [4e7] * 8), (361, [-4e7] * 8), (362, [1e5, 1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rid int, q string")
    got = bit_sliced.top_k(df, F.col("vec_id") % 20 == 0, k=7, block_rows=64, query_rows=8).collect()
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for a, (i, x) in enumerate(kept):
        if i % 20 == 0:
            scored = sorted((-sum(p * q for p, q in zip(x.tolist(), y.tolist())), j) for b, (j, y) in enumerate(kept) if a != b and len(x) == len(y))[:7]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(expected)
    assert bit_sliced.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_components_beyond_64_bits(spark):
    df = spark.createDataFrame([(20, [0.0, 2.0, -1.0]), (1, [1e30, 1.0, 0.5]), (2, [-1e200, -3.0, 0.0]), (3, [5.0, 1e9, 1e9]), (4, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = bit_sliced.top_k(df, F.col("vec_id") == 20).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(1, 3, 64 * 64 * 10**9), (2, 1, 128 * 64 - 64 * 32), (3, 4, 0), (4, 2, -128 * 192)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(same_rows, name):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_each_word_of_a_run_is_looked_up_once(monkeypatch):
    from tokenizers import Tokenizer

    texts = ["", " ", "One two, two. TWO\n\nΣΑΣ İstanbul", "naïve  e\u0301 x" + "y" * 80 + ", z\t9.", "the cat, the dog. " * 5000]
    asked = []

    class Known(dict):
        def __getitem__(self, word):
            asked.append(word)
            return dict.__getitem__(self, word)

    held = packing._encoder(WORD)
    monkeypatch.setattr(packing, "_encoder", lambda _: (*held[:4], Known()))
    plain = Tokenizer.from_file(WORD)
    wanted = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.encode_words(texts, WORD) == wanted
    assert len(asked) < 60  # not the 20,000 words
    assert packing.encode_words([], WORD) == [] and packing.encode_words(["", ""], WORD) == [b"", b""]
