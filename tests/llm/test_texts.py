"""Operators on whole texts against brute force and on held-out labels."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditjobs.llm import _graph, html_extract, lm_score, ngram_join, quality_crf, queries, repeat_removal, toxicity
from auditjobs.llm._io import Scratch


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=3):
    """Near copies, shared passages, copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))
    passage = " ".join(word() for _ in range(40))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    for i in range(40):
        own = [word() for _ in range(rng.randrange(2, 80))]
        rows.append(" ".join(own[:5] + [passage] * (i % 3) + own[5:]))
    rows += [None, "", " \n ", "One two", "one TWO", "x", rows[0], rows[61], rows[61], "To " * 300, "to " * 310, "é " * 50]
    table = [(1000 - i if i % 4 else i, t) for i, t in enumerate(rows)]
    return table + [(None, rows[61]), (None, None), (7, "repeated id one two three"), (7, "another text of that id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], "doc_id long, text string, rid int, sid string, component string, n int")


@pytest.mark.parametrize("n, num, small", [(3, 90, False), (5, 80, False), (5, 80, True), (2, 50, True)])
def test_components(spark, monkeypatch, n, num, small):
    if small:
        for name, value in (("GROUP_SETS", 3), ("TILE_SETS", 4), ("TILE_TOKENS", 300), ("HEAP_ENTRIES", 4), ("PIVOTS", 1), ("PIVOT_ROUNDS", 1)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = corpus()
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= num * (len(a) + len(sets[j]) - common):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    got = ngram_join.similar_components(frame(spark, rows), n, num).collect()
    key = lambda d, size, c: (d is None, d or 0, size, c is None, c or 0)
    assert sorted(key(r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(key(d, len(sets[i]), least[i]) for i, (d, _) in enumerate(rows))
    assert sum(r["first"] for r in got) == len({find(i) for i in range(len(rows))})


def test_no_rows(spark):
    empty = frame(spark, [])
    assert ngram_join.similar_components(empty).count() == 0
    assert repeat_removal.remove_repeats(empty).count() == 0
    assert lm_score.stupid_backoff(empty).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    bitmap = np.packbits(rng.random(ngram_join.CELLS) < 0.3)
    for num in (50, 80, 90):
        for _ in range(300):
            size = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            b = a[rng.random(len(a)) > rng.random() * 0.12]
            b = np.unique(np.concatenate([b, rng.integers(0, 2**64, int(rng.integers(0, max(1, size // 10) + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and 100 * common >= num * (len(a) + len(b) - common):
                assert np.intersect1d(ngram_join.document_keys(a, bitmap, num, 100), ngram_join.document_keys(b, bitmap, num, 100)).size
                assert np.intersect1d(ngram_join.strict_keys(a, len(a), num, 100), ngram_join.strict_keys(b, len(b), num, 100)).size


def test_words_of_two_letters_differ():
    """Words that polynomial hashes modulo a power of two cannot tell apart."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    import pyarrow as pa

    sets = dict(ngram_join.shingle_sets(pa.array([a, b, a.upper(), a[:300], b[:300], a[:40], b[:40]]), 3))
    assert [int(x[0]) for x in sets.values()].count(int(sets[0][0])) == 2
    assert len({int(x[0]) for x in sets.values()}) == 6


def test_search_finds_what_every_pair_shows():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 80, dtype=np.uint64)
    sets = []
    for _ in range(150):
        keep = base[rng.random(80) > rng.random() * 0.3]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, 14)), dtype=np.uint64)])))
    for num in (60, 80, 90):
        linked = [[100 * (c := len(np.intersect1d(a, b))) >= num * (len(a) + len(b) - c) for b in sets] for a in sets]
        index = ngram_join.Index(sets)
        for i, a in enumerate(sets):
            assert sorted(index.search(a, num, 100, np.arange(len(sets)), -1)) == [j for j in range(len(sets)) if linked[i][j]]
        up = ngram_join.links_within(sets, num, 100)
        graph = {i: i for i in range(len(sets))}
        for _ in range(len(sets)):
            for i, j in up:
                graph[i] = graph[j] = min(graph[i], graph[j])
        whole = {i: i for i in range(len(sets))}
        for _ in range(12):
            for i in whole:
                whole[i] = min(whole[j] for j in range(len(sets)) if linked[i][j])
        assert graph == whole


def test_large_group_of_near_copies(spark):
    """Many near copies of one text, a part of them linked to nothing, at the production constants."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(900):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(70)] = f"u{rng.randrange(60 if i % 2 else 10**9)}"
        if i % 3 == 0:
            words = words[rng.randrange(6) : 70 - rng.randrange(6)]
        rows.append((i, " ".join(words)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert len(set(got.values())) > 50
    assert got == {i: find(i) for i in sets}


def test_joined_edges():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(-30, 30, (2, rng.integers(0, 25)))
        up = {v: v for v in [*a.tolist(), *b.tolist()]}
        for _ in up:
            for p, q in zip(a.tolist(), b.tolist()):
                up[p] = up[q] = min(up[p], up[q])
        x, y = ngram_join.joined(a, b)
        assert dict(zip(x.tolist(), y.tolist())) == {v: r for v, r in up.items() if v != r}


@pytest.mark.parametrize("in_task", [2_000_000, 20, -1])
def test_graph_components(spark, monkeypatch, in_task):
    """In one task from the start, after rounds, and by rounds alone."""
    monkeypatch.setattr(_graph, "TASK_EDGES", in_task)
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(9, 9)]
    up = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in _graph.components(df, Scratch(spark)).collect()}
    least = {}
    for x, c in got.items():
        least[c] = min(x, least.get(c, x))
    assert {x: least[c] for x, c in got.items()} == up and all(got[c] == c for c in got.values())
    assert _graph.components(df.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("crowded, starts", [(2000, 1 << 20), (2, 1 << 20), (2000, 170)])
def test_repeats(spark, monkeypatch, crowded, starts):
    """With few string starts at a time, each row is a batch, so that every text of more goes by pieces."""
    monkeypatch.setattr(repeat_removal, "ANCHOR_SEGMENTS", crowded)
    monkeypatch.setattr(repeat_removal, "STARTS", starts)
    rng = random.Random(4)
    line = lambda k: "".join(rng.choice("abcdé 中") for _ in range(k))
    shared = [line(90), line(150), line(400)]
    rows = [(i, line(rng.randrange(60)) + rng.choice(shared) + line(rng.randrange(90)) + rng.choice(shared)) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "short"), (73, "x" * 100), (74, "x" * 101), (75, "ab" * 400), (3, rows[5][1]), (3, rows[5][1]), (76, shared[2] * 20)]
    seen, expected = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                mark[p] += 1
                mark[p + 100] -= 1
            seen.add(w)
        gone = np.cumsum(mark)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        expected.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(batch)
    try:
        spark.conf.set(batch, "1" if starts < 1000 else held)
        got = repeat_removal.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    finally:
        spark.conf.set(batch, held)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(expected)


def test_repeats_of_odd_tables(spark):
    """A null id comes before all others; extra columns of the operator's own names are no matter; no rows give none."""
    text = "".join(map(chr, range(97, 117))) * 6
    docs = spark.createDataFrame([(1, text, 7, "a"), (None, text, 8, "b"), (2, None, 9, None)], "doc_id long, text string, rid long, body string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_text) for r in repeat_removal.remove_repeats(docs).collect()}
    assert got == {None: (120, 100, text[:20]), 1: (120, 120, ""), 2: (0, 0, "")}
    assert repeat_removal.remove_repeats(docs.limit(0)).count() == 0


def test_column_wise_order():
    rng = random.Random(0)
    for _ in range(50):
        strings = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(1, 12))]
        lengths = np.array([len(s) for s in strings])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        string, size, common = repeat_removal.column_wise(np.frombuffer(b"".join(strings), np.uint8), starts, lengths, 6)
        suffixes = [strings[i][len(strings[i]) - j :] for i, j in zip(string, size)]
        assert suffixes == sorted(suffixes) and len(suffixes) == lengths.sum() + len(strings)
        for a, b, k in zip(suffixes, suffixes[1:], common[1:]):
            m = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert min(m, 6) == k


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(spark, order):
    rows = corpus()
    texts = [words_of(t) for _, t in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, texts))

    def score(words):
        s = 0.0
        for i in range(len(words)):
            weight = 0.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(words[i - n + 1 : i + 1])
                if n == 1:
                    s += weight + math.log(counts[gram] / total)
                elif counts[gram] >= 2:
                    s += weight + math.log(counts[gram] / counts[gram[:-1]])
                    break
                else:
                    weight += math.log(0.4)
        return s

    got = lm_score.stupid_backoff(frame(spark, rows), order).collect()
    key = lambda d, n, s: (d is None, d or 0, n, round(s, 6))
    assert sorted(key(r.doc_id, r.n_words, r.log_score) for r in got) == sorted(key(d, len(w), score(w)) for (d, _), w in zip(rows, texts))


def test_registered_scores_have_contexts_of_two_words(spark):
    from tests.conftest import DATA

    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    texts = [words_of(r.text) for r in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in (1, 2, 3) for i in range(len(w) - n + 1))
    expected = {}
    for r, w in zip(rows, texts):
        s = 0.0
        for i in range(len(w)):
            three, two = tuple(w[i - 2 : i + 1]) if i > 1 else (), tuple(w[i - 1 : i + 1]) if i else ()
            if counts[three] >= 2:
                s += math.log(counts[three] / counts[three[:2]])
            elif counts[two] >= 2:
                s += math.log((0.4 if three else 1) * counts[two] / counts[two[:1]])
            else:
                s += math.log((0.16 if three else 0.4 if two else 1) * counts[(w[i],)] / sum(map(len, texts)))
        expected[r.doc_id] = s
    got = {r.doc_id: r.log_score for r in queries.op2_lm_score(spark, DATA).collect()}
    assert got == pytest.approx(expected, abs=2e-3)


def test_scores_do_not_hang_on_splits(spark, tmp_path):
    """Each scan of the documents may cut them elsewhere."""
    frame(spark, corpus()).coalesce(1).write.option("parquet.block.size", 2000).option("parquet.page.size", 500).option("parquet.block.size.row.check.min", 5).parquet(str(tmp_path / "d"))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, round(r.log_score, 6))
    docs = lambda: spark.read.parquet(str(tmp_path / "d"))
    whole = sorted(map(key, lm_score.stupid_backoff(docs()).collect()))
    out = lm_score.stupid_backoff(docs())  # counted over one split, scored over others
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in held:
            spark.conf.set(c, "3000")
        assert docs().rdd.getNumPartitions() > 1
        cut = sorted(map(key, lm_score.stupid_backoff(docs()).collect()))
        late = sorted(map(key, out.select("*").collect()))
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert cut == whole == late


def test_forward_backward_sums_over_all_labelings():
    rng = np.random.default_rng(3)
    first = np.array([0, 4, 5, 8])
    scores, between = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    marginals, moves, total = quality_crf.forward_backward(scores, between, first)
    whole, seen = 0.0, np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        weights = {}
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            weights[tuple(y)] = math.exp(sum(scores[a + k, v] for k, v in enumerate(y)) + sum(between[u, v] for u, v in zip(y, y[1:])))
        z = sum(weights.values())
        whole += math.log(z)
        for y, w in weights.items():
            for u, v in zip(y, y[1:]):
                seen[u, v] += w / z
        for k in range(b - a):
            assert marginals[a + k, 1] == pytest.approx(sum(w for y, w in weights.items() if y[k]) / z)
    assert total == pytest.approx(whole) and moves == pytest.approx(seen)


@pytest.mark.parametrize("block", [None, 1, 2, 7])
def test_marginals_by_blocks_equal_forward_backward(block):
    rng = np.random.default_rng(5)
    first = np.array([0, 1, 3, 900, 901, 1000])
    scores, between = np.zeros((1000, 2)), rng.normal(size=(2, 2)) * 3
    scores[:, 1] = rng.normal(size=1000) * 5
    want = quality_crf.forward_backward(scores, between, first)[0][:, 1]
    ahead = quality_crf.log_odds(scores[:, 1], between, first, block)
    back = quality_crf.log_odds(scores[::-1, 1].copy(), between.T, 1000 - first[::-1], block)[::-1]
    assert 1 / (1 + np.exp(scores[:, 1] - ahead - back)) == pytest.approx(want, abs=1e-9)
    assert quality_crf.good_marginals(scores[:, 1], between, first) == pytest.approx(want, abs=1e-9)


def test_quality_of_windows_and_of_very_many_lines(monkeypatch):
    theta = np.linspace(-1, 1, 3 * quality_crf.OWN + 4)
    texts = [b"", b"A b.\n" * 40, b"", b"\n\nx", b"one two two | 3!\nlow"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    whole = quality_crf.document_scores(theta, data, offsets)
    monkeypatch.setattr(quality_crf.windows, "__defaults__", (3,))
    assert quality_crf.document_scores(theta, data, offsets) == pytest.approx(whole, abs=1e-12)
    monkeypatch.undo()
    feeds = np.full(4 << 20, 10, np.uint8)
    tracemalloc.start()
    score = quality_crf.document_scores(theta, feeds, np.array([0, len(feeds)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score[0] <= 1 and peak < 120 * len(feeds)


def test_toxicity_fit_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i, f"you utter scum and filth {i}" if i % 2 else f"a pleasant walk in the garden {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    once, twice = toxicity.train(docs, labels, F.lit(True)), toxicity.train(docs.union(docs), labels.union(labels), F.lit(True))
    scores = [{r.doc_id: r.score for r in toxicity.score(docs, m).collect()} for m in (once, twice)]
    assert scores[0] == pytest.approx(scores[1]) and min(scores[0][i] for i in range(1, 40, 2)) > max(scores[0][i] for i in range(0, 40, 2))


def test_fit_of_repeated_ids_and_bounded_lines(spark):
    docs = spark.createDataFrame([(i % 9, f"Good line {i % 9}.\n" * 3 if i % 2 else "|| 9 !!\n" * 3) for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    once = quality_crf.train(docs, labels, F.lit(True))
    assert quality_crf.train(docs.union(docs), labels.union(labels), F.lit(True)) == pytest.approx(once)
    few = quality_crf.train(docs.union(spark.createDataFrame([(99, "\n" * 50)], docs.schema)), labels.union(spark.createDataFrame([(99, 1)], labels.schema)), F.lit(True), lines_most=40)
    assert few.shape == once.shape and np.isfinite(few).all()
    assert not quality_crf.train(docs, labels, F.lit(True), lines_most=0).any()


ODD = [(1, None), (2, ""), (3, "\n\n\n"), (4, "x" * 300_000), (5, "A b.\n" * 3000), (None, "no id"), (6, "same"), (6, "same")]


@pytest.mark.parametrize("name, label, folds, held, threshold, least", [("op3_toxicity", "toxic", 3, 1, 0.7, 0.9), ("op4_quality_crf", "quality", 5, 0, 0.3, 0.93)])
def test_held_out_labels(spark, name, label, folds, held, threshold, least):
    from tests.conftest import DATA

    got = queries.QUERIES[name](spark, DATA.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(DATA.replace("sf0.001", "sf0.01") + "/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


def test_scores_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "z") for i, t in ODD], "doc_id long, text string, score double, label string")
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    always = F.lit(True)
    theta = quality_crf.train(docs, labels, always)
    model = toxicity.train(docs, labels, always)
    for got in (quality_crf.score(docs, theta).collect(), toxicity.score(docs, model).collect()):
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    # labels of one kind or none teach nothing but do no harm
    for few in (labels.limit(0), labels.filter("quality = 1 and toxic = 1")):
        assert all(r.score == pytest.approx(0.5) for r in quality_crf.score(docs, quality_crf.train(docs, few, always)).collect())
        assert max(r.score for r in toxicity.score(docs, toxicity.train(docs, few, always)).collect()) < 0.01
    assert quality_crf.score(docs.limit(0), theta).count() == toxicity.score(docs.limit(0), model).count() == 0


def test_scores_do_not_hang_on_neighbours(spark):
    """A document's score is the same in any batch."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string").filter("doc_id is not null").dropDuplicates()
    theta = np.linspace(-1, 1, 3 * quality_crf.OWN + 4)
    together = {r.doc_id: r.score for r in quality_crf.score(docs.coalesce(1), theta).collect()}
    for i, _ in together.items():
        assert quality_crf.score(docs.filter(F.col("doc_id") == i), theta).first().score == pytest.approx(together[i])


def test_label_model_discounts_twins():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.3).astype(float)
    good = ((rng.random((2000, 3)) < np.where(y, 0.8, 0.1)[:, None])).astype(float)
    noisy = (rng.random(2000) < np.where(y, 0.5, 0.45)).astype(float)
    given = np.where(rng.random(2000) < 0.1, 1 - y, y)
    votes = np.concatenate([good, np.repeat(noisy[:, None], 8, axis=1)], axis=1)
    posterior = toxicity.label_model(votes, given)
    assert np.mean((posterior > 0.5) == y) > 0.89  # eight copies of a noisy voter do not outvote a label of 90 % accuracy
    assert np.mean((votes.mean(axis=1) > 0.5) == y) < 0.6


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></ul></nav><header>Head</header><div class="cookie-notice">We use cookies</div><div class="xyz">Only on this site</div>
<article class="post has-sidebar"><h1>Title &amp; more</h1><p><b>First <i>bold</i> text<br>same block<p>Second&nbsp;one   with
blanks</p><div class="ad">Buy</div><form><p>Mail</form><ul><li>one<li>two</ul><section id="comments"><p>Nice</section><!-- c --></article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst bold text same block\nSecond one with blanks\none\ntwo"
    assert html_extract.main_text("") == "" and html_extract.main_text("plain <b>text") == "plain text"
    assert html_extract.main_text("<p>a < b and c<d</p>") .startswith("a < b")
    assert html_extract.main_text("<body><p hidden>x</p><p style='display: none'>y</p><p>z") == "z"
    assert html_extract.main_text("<script>never closed <p>x") == ""
    deep = "<div>" * 20000 + "deep" + "</div>" * 20000
    assert html_extract.main_text(deep) == "deep"


def test_site_templates(spark):
    page = lambda host, i: f"<body><div class=q>Site words of {host}</div><p>own text {host} {i}</p><div>tail <b>of {host}</b></div>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page(f"h{i % 2}", i)) for i in range(20)]
    rows += [(50, "http://few.example/1", page("few", 1)), (51, None, None), (52, "no url", ""), (53, "https://user@H0.example:80/z", page("h0", 53)), (53, "x", "<p>twice")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, host string, templates int")
    got = defaultdict(list)
    for r in html_extract.extract(df).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].append(r.text)
    assert got[4] == ["own text h0 4"] and got[53] == ["own text h0 53", "twice"] or got[53] == ["twice", "own text h0 53"]
    assert got[50] == ["Site words of few\nown text few 1\ntail of few"]
    assert got[51] == got[52] == [""]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_copies_and_shared_paragraphs_stay(spark):
    wrap = lambda i, inner: f"<body><div class=q>Site words</div><article><h1>T{i}</h1><p>own text {i}</p>{inner}</article>"
    rows = [(i, "http://a.example/", "<body><p>copied page</p><p>its <b>end</b></p>") for i in range(6)]
    rows += [(10 + i, "http://a.example/", f"<body><div><p>page {i}</p></div>") for i in range(8)]
    rows += [(30 + i, "http://b.example/", wrap(i, "<p>shared <b>note</b></p>" if i < 6 else "")) for i in range(12)]
    # without an article element: the same paragraph, here and there on the page, is no template; the line at the end is
    rows += [(50 + i, "http://c.example/", "<body>" + "".join(f"<p>one {i} {k}</p>" for k in range(i)) + "<p>often said</p>" + "".join(f"<p>two {i} {k}</p>" for k in range(9 - i)) + "<div>All rights</div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"copied page\nits end"}
    assert got[30] == "T0\nown text 0\nshared note" and got[41] == "T11\nown text 11"
    assert all("often said" in got[50 + i] and "All rights" not in got[50 + i] for i in range(8))
    # many pages are enough on a host on which no share of them is reached
    pages = spark.createDataFrame([("d", f"<p>{i}</p>" + ("<div>foot</div>" if i < 6 else "")) for i in range(40)], "host string, html string")
    assert html_extract.site_templates(pages).count() == 0
    assert len(html_extract.site_templates(pages, many_pages=6).first().templates) == 2


def test_rows_keep_their_numbers_on_other_splits(spark, tmp_path):
    """Between two jobs a scan may be dealt anew, as when an executor leaves."""
    import corpus_pipeline

    rows = [(i, t, "en", "s", 1) for i, t in enumerate(t for _, t in corpus())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7).write.parquet(str(tmp_path / "d"))
    docs = lambda: spark.read.parquet(str(tmp_path / "d"))
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    stages = corpus_pipeline.exact_copies, corpus_pipeline.near_copies, corpus_pipeline.repeated_passages
    whole = [key(stage(spark, docs(), None)) for stage in stages]
    begun = [stage(spark, docs(), None) for stage in stages]
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    parts = docs().rdd.getNumPartitions()
    try:
        for c in held:
            spark.conf.set(c, "100")
        assert docs().rdd.getNumPartitions() > parts
        assert [key(df.select("*")) for df in begun] == whole
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_pipeline(spark):
    import corpus_pipeline
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("body", F.lit("clash"))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = Scratch(spark).cut(out)
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 2
    assert out.select("doc_id").distinct().count() == sizes[-1]
    texts = [r.text for r in docs.collect()]
    assert len({t for t in texts if len(t) > 200}) == sum(len(t) > 200 for t in texts)
    assert corpus_pipeline.run(spark, DATA).count() == out.count()
    odd = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = Scratch(spark).cut(stage(spark, rows, DATA))


def test_stages_equal_brute_force(spark):
    """Stages 2 to 5 on a small table against plain Python, row by row."""
    import binascii

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    words = lambda k: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(k))
    passage, base, long = words(30), words(60), words(3000)
    texts = [words(rng.randrange(5, 50)) for _ in range(20)] + [words(8) + " " + passage + " " + words(8) for _ in range(4)]
    texts += [base, base + " one", "Two " + base, base.upper(), base, long, long + " end", "", None, "  ", "word", "word", texts[0], texts[1], texts[1]]
    rows = [(i * 3 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    held = []
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = Scratch(spark).cut(stage(spark, docs, None))
        held.append(docs.collect())

    newest = {}
    for i, t, *_ in rows:
        newest[t or ""] = max(i, newest.get(t or "", 0))
    kept = {i: t for i, t, *_ in rows if newest[t or ""] == i}
    assert sorted((r.doc_id, r.text) for r in held[0]) == sorted(kept.items())

    def shingled(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, lead = {i: shingled(t) for i, t in kept.items()}, {i: i for i in kept}
    for _ in kept:
        for a in kept:
            for b in kept:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    lead[a] = lead[b] = min(lead[a], lead[b])
    kept = {i: t for i, t in kept.items() if lead[i] == i}
    assert sorted((r.doc_id, r.text) for r in held[1]) == sorted(kept.items())

    seen = set()
    for i in sorted(kept):
        b = (kept[i] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        kept[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in held[2]) == sorted((i, t, len(t)) for i, t in kept.items())
    assert any(len(t) < len(dict((i, t or "") for i, t, *_ in rows)[i]) for i, t in kept.items())

    tokenizer, pieces = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), []
    for i, t in kept.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        pieces += [(i, at // 4096, at, len(ids[at : at + 4096]), binascii.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in held[3]) == sorted(pieces)
    bins = []
    for size in sorted((p[3] for p in pieces), reverse=True):
        room = [g for g in bins if g >= size]
        if room:
            bins.remove(min(room))
        bins.append((min(room) if room else 4096) - size)
    ends = {}
    for r in sorted(held[3], key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) == len(bins)


def test_frequent_cells_are_counted_in_one_pass_without_a_table(spark, monkeypatch):
    texts = [t for _, t in corpus()] + [None, ""]
    sets = [tokens for _, tokens in ngram_join.shingle_sets(pa.array(texts, pa.string()), 3)]
    counted = np.bincount((np.concatenate(sets) >> np.uint64(42)).astype(np.int64), minlength=ngram_join.CELLS)
    wanted = np.packbits(counted >= ngram_join.FREQUENT_TIMES * counted.sum() / ngram_join.CELLS + ngram_join.FREQUENT_LEAST)
    cuts = []
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name="t": cuts.append(name) or df)
    found = ngram_join.frequent_cells(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 3, int(counted.sum()))
    assert (found == wanted).all() and found.any() and not cuts
