"""Conversation repair, hard negatives and decontamination against brute force, with nulls, empty and long values, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditjobs.llm import conversation_repair, decontaminate, hard_negatives, queries
from tests.conftest import DATA

CLASH = "rid long, wid long, sid long, words string, copies int, kind int, label2 int, place int"
ODD = (1, 2, 3, "w", 4, 5, 6, 7)


# ---- conversations -------------------------------------------------------------------------------

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _with_inserts(best):
    todo = list(best.items())
    while todo:
        state, (cost, audit, rows) = todo.pop()
        for initial, name in (("u", "user"), ("a", "assistant")):
            to = STEP.get((state, initial))
            found = (cost + 3, audit + "I", rows + ((name, ""),))
            if to is not None and not audit.endswith("IIII") and (to not in best or found[:2] < best[to][:2]):
                best[to] = found
                todo.append((to, found))
    return best


def _repair(rows):
    """Gaps, faults, illegal pairs, cost, audit and repaired rows of one conversation, with whole strings in the states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns = {t for t, _, _ in rows if t is not None}
    seen, faults, best = set(), [], {0: (0, "", ())}
    for _, role, text in rows:
        text_end = text.strip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not text_end else "duplicate" if (role, text) in seen else "truncated" if text_end not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        after, more = {}, 3 if fault == "truncated" else 0
        for state, (cost, audit, kept) in _with_inserts(best).items():
            edits = [(state, (cost + 4, audit + "D", kept))]
            if fault not in ("blank", "duplicate"):
                if (state, role[:1]) in STEP:
                    edits.append((STEP[state, role[:1]], (cost + more, audit + "K", kept + ((role, text),))))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in STEP:
                        edits.append((STEP[state, initial], (cost + 3 + more, audit + "R", kept + ((name, text),))))
            for to, found in edits:
                if to not in after or found[:2] < after[to][:2]:
                    after[to] = found
        best = after
    best = _with_inserts(best)
    cost, audit, kept = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit), kept


def _damage(rows):
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return convs


def _turns(rng):
    texts = ["Hi.", "Hi", "", " \n", "So?", "Yes!", "No. ", "x" * 3, None, "long " * 40_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts)) for c in [*range(60), None] for t in range(rng.randrange(1, 14))]
    rows += [(7, 3, "user", "Hi."), (7, 3, "user", "Hi."), (7, 3, "assistant", "Hi."), (1000, None, None, None)]
    return rows + [(2000, t, ("user", "assistant")[t % 2], f"turn {t // 3}.") for t in range(900)]


def test_conversations(spark):
    rows = _turns(random.Random(3))
    turns = spark.createDataFrame([(*r, *ODD) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")
    damaged = conversation_repair.damaged(turns)
    audits = conversation_repair.audit(damaged)
    got = {r.conv_id: tuple(r)[1:] for r in audits.collect()}
    fixed = conversation_repair.repaired(damaged, audits)
    kept = {}
    for r in fixed.collect():
        kept.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    hashes = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(fixed).collect()}
    for conv, own in _damage(rows).items():
        if own:
            told, repaired = _repair(own)
            assert got.pop(conv) == told
            assert [x[1:] for x in sorted(kept.pop(conv, []))] == list(repaired)
            if repaired:
                assert hashes[conv] == hashlib.sha256("\n".join(map(":".join, repaired)).encode()).hexdigest()
    assert not got and not kept


def test_conversation_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, DATA).collect()}
    for conv, own in _damage(rows).items():
        told, repaired = _repair(own) if own else ((0, 0, 0, 0, 0, 0, ""), ())
        assert got.pop(conv) == (*told, hashlib.sha256("\n".join(map(":".join, repaired)).encode()).hexdigest())
    assert not got


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, 1, "user", "a."), (12, 20, None, None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "few" / "conversations.parquet"))
    assert {r.conv_id for r in queries.op11_conversation_repair(spark, str(tmp_path / "few")).collect()} == {1, 12}


def test_layers_are_shared():
    made = []
    plain = conversation_repair.next_layer

    def counted(layer, symbol):
        made.append(symbol)
        return plain(layer, symbol)

    signatures = ["", "sua", "suau", "suaux", "sux", "u"]
    batch = pa.RecordBatch.from_arrays([pa.array(signatures)], ["signature"])
    try:
        conversation_repair.next_layer = counted
        answers = {r["signature"]: r["audit"] for b in conversation_repair.solve(iter([batch])) for r in b.to_pylist()}
    finally:
        conversation_repair.next_layer = plain
    assert len(made) == 3 + 1 + 1 + 1 + 1  # one layer a node of the trie
    assert answers[""] == "" and answers["sua"] == "KKK" and answers["suau"] == "KKKKI"


# ---- vectors -------------------------------------------------------------------------------------


def _negatives(rows, positives=5, negatives=5):
    ok = [(i, [math.floor(256 * x) if abs(x) < 2**40 else int(x) * 256 for x in v], y, n) for n, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, q, label, n in ok:
        if a is None or a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), i is None, i or 0, y == label, i) for i, v, y, m in ok if m != n and len(v) == len(q)]
        for p in sorted(x for x in scored if x[3])[:positives]:
            near = sorted(x for x in scored if not x[3] and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0])[:negatives]
            out += [(a, p[4], r, x[4], -p[0], -x[0]) for r, x in enumerate(near, 1)]
    return out


def _mine(spark, rows, **more):
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], y, *ODD) for i, v, y in rows], f"vec_id long, embedding array<double>, label int, {CLASH}")
    return [tuple(r) for r in hard_negatives.hard_negatives(df, F.col("label"), F.col("vec_id") % 10 == 0, **more).collect()]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_hard_negatives(spark):
    rng = random.Random(11)
    vector = lambda: [rng.gauss(0, 0.3) for _ in range(6)]
    rows = [(i, vector(), rng.randrange(3)) for i in range(400)]
    hot = vector()
    rows += [(1000 + i, hot, i % 2) for i in range(150)]  # a frequent vector: ties at every border
    rows += [(10, vector(), 1), (10, rows[10][1], rows[10][2]), (None, hot, 0), (None, hot, 1)]
    rows += [(2000, None, 1), (2010, [0.1, None, 0, 0, 0, 0], 1), (2020, [float("nan")] * 6, 1), (2030, [float("inf")] * 6, 1), (2040, vector(), None)]
    rows += [(2050, [0.5, 0.5], 1), (2060, [0.4, 0.5], 0), (2061, [0.5, 0.5], 1), (2070, [], 0), (2071, [], 1), (2072, [], 0)]
    want = key(_negatives(rows))
    assert len(want) > 500 and any(r[4] == r[5] for r in want)
    for more in ({}, {"block_rows": 50, "anchor_rows": 20, "cells": 4}, {"block_rows": 7, "cells": 256}):
        assert key(_mine(spark, rows, **more)) == want


def test_hard_negatives_of_wide_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.0, 2.0**20, 2.0**15 + 0.5, -3.25e5]) * rng.random() for _ in range(4)], i % 2) for i in range(120)]
    want = key(_negatives(rows))
    assert want and max(r[4] for r in want) > 2**50
    assert key(_mine(spark, rows, block_rows=16)) == want
    with pytest.raises(Exception, match="64 bits"):
        _mine(spark, [(i, [2.0**60, 1.0], i % 2) for i in range(12)])
    # what no result needs does no harm
    assert _mine(spark, [*rows, (5001, [-1e300] * 4, 1)]) and key(_mine(spark, [*rows, (5001, [-1e300, 0, 0, 0], 1)])) == key(_negatives([*rows, (5001, [-1e300, 0, 0, 0], 1)]))


def test_no_vectors(spark):
    assert _mine(spark, []) == []
    assert _mine(spark, [(0, [1.0], 1)]) == []
    assert _mine(spark, [(1, [1.0], 1), (2, [1.0], 0)]) == []


def test_vector_query(same_rows):
    same_rows(queries.op12_hard_negatives, queries.ORACLE_SQL["op12_hard_negatives"])


# ---- benchmark windows ---------------------------------------------------------------------------


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _leaks(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def _found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, *ODD) for i, t in docs], f"doc_id long, text string, {CLASH}")
    b = spark.createDataFrame([(i, t, *ODD) for i, t in items], f"item_id long, text string, {CLASH}")
    rows = decontaminate.decontaminate(d, b, **more).collect()
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr)


def _corpus(rng):
    words = ["the", "of", "a", "ÉTÉ", "étÉ", "x1", "Zed", "naïve", "ΣΑΣ", "q", "is", "İx"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "-", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 5, 6, 9, 10, 11, 30]) if i % 3 else 25)) for i in range(24)]
    items += [(3, text(14)), (None, text(12)), (50, None), (51, ""), (52, " ,. "), (53, "the of a the of a the of a the of a")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(100 + i, f"{text(5)} {t} {text(4)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, items[0][1].upper()), (201, items[0][1] + " " + items[3][1]), (200, items[0][1].upper()), (None, items[2][1]), (300, None), (301, ""), (302, "\n.,")]
    return docs + [(400, text(30_000)), (401, " ".join(["the of a"] * 5000))], items


def test_decontamination(spark, monkeypatch):
    rng = random.Random(2)
    docs, items = _corpus(rng)
    want = sorted(_leaks(docs, items), key=repr)
    assert sum(r[2] > 0 for r in want) > 30
    assert _found(spark, docs, items) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 1)
    assert _found(spark, docs, items) == want
    long_only = [x for x in items if len(_words(x[1])) >= 6]
    assert _found(spark, docs, long_only, window=6, shingle=4) == sorted(_leaks(docs, long_only, 6), key=repr)


def test_no_items_or_documents(spark):
    assert _found(spark, [], [(1, "a b c")]) == []
    assert _found(spark, [(1, "a b c"), (2, None)], []) == [(1, 3, 0, []), (2, 0, 0, [])]


def test_only_ascii_is_folded(spark):
    letters = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", decontaminate.words_of(F.col("c")).alias("w"))
    assert rows.filter((F.ascii("c") > 127) & (F.get("w", F.lit(0)) != F.col("c"))).count() == 0


def test_leak_query(same_rows):
    same_rows(queries.op13_decontamination, queries.ORACLE_SQL["op13_decontamination"])
