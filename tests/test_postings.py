"""Search through trigrams: the same results, fewer files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditjobs.jobs import files as J
from auditjobs.operators import context as X
from auditjobs.operators import postings as P


@pytest.mark.parametrize(
    "pattern, told",
    [
        ("licen[sc]e|License", [["licen"], ["License"]]),
        ("function +withdraw", [["function ", "withdraw"]]),
        (r"msg\.sender", [["msg.sender"]]),
        ("abcd?efg+hij", [["abc", "efg", "hij"]]),
        ("(abc|def)ghij(klm)?", [["ghij"]]),
        ("abcd{0,3}efgh", [["abc", "efgh"]]),
        ("^call$", [["call"]]),
        ("abc|de", None),
        ("(?i)token", None),
        (r"\Qa.b\Ecd", None),
        (r"\x41bcd", None),
        ("[[a-z]b]cde", None),
        ("[]abc]def", None),
        ("", None),
    ],
)
def test_required_literals(pattern, told):
    assert P.required_literals(pattern) == told


def corpus(rng):
    words = ["licence", "license", "call", "transfer(x)", "über", "token", "to", "\U0001f600\U0001f600\U0001f600", "a.b"]
    rows = [("r" if i % 3 else "q", f"f{i:02d}.sol", "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(3))) for _ in range(rng.randrange(4)))) for i in range(60)]
    return [*rows, ("r", "none.sol", None), ("s", "empty.sol", ""), ("r", "dup.sol", "call call call"), ("r", "long.sol", "x" * 200_000 + " token")]


@pytest.mark.parametrize("listed", [1000, 2])
def test_same_results_from_fewer_files(spark, monkeypatch, listed):
    monkeypatch.setattr(P, "LISTED_FILES", listed)
    rows = corpus(random.Random(4))
    sources = spark.createDataFrame([(*r, 1) for r in rows], "repo string, path string, content string, trigram int")
    held = {(r.trigram, r.repo, r.path) for r in P.trigram_postings(sources).collect()}
    assert held == {(line[i : i + 3], repo, path) for repo, path, text in rows for line in (text or "").split("\n") for i in range(len(line) - 2)}
    postings = spark.createDataFrame(sorted(held), "trigram string, repo string, path string").cache()
    for pattern in ("licen[sc]e|a\\.b", "transfer\\(x\\) call", "über", "\U0001f600{3}|token", "\U0001f600\U0001f600\U0001f600", "to", "absent"):
        found = P.only_candidates(sources, postings, pattern)
        hits = {(repo, path) for repo, path, text in rows if any(re.search(pattern, line) for line in (text or "").split("\n"))}
        read = {(r.repo, r.path) for r in found.collect()}
        assert hits <= read
        told = P.required_literals(pattern)
        if told:
            grams = [{t[i : i + 3] for t in branch for i in range(len(t) - 2)} for branch in told]
            assert read == {(repo, path) for repo, path, _ in rows if any(all((g, repo, path) in held for g in branch) for branch in grams)} and len(read) < len(rows) - 3
        assert sorted(map(tuple, X.grep(sources, pattern, postings=postings).collect())) == sorted(map(tuple, X.grep(sources, pattern).collect()))
    assert P.trigram_postings(sources.limit(0)).count() == 0
    assert X.grep(sources.limit(0), "token", postings=postings).count() == 0


def test_stored_postings_prune_the_scan(spark, tmp_path):
    """A stored index answers a search; its scan gets the trigrams, and that of the sources the paths."""
    store = J.Store(spark, str(tmp_path / "store"))
    for repo in ("007", "b"):
        (tmp_path / repo).mkdir()
        for i in range(12):
            (tmp_path / repo / f"C{i}.sol").write_text(f"contract C{i} {{\n    // mark{i}x of {repo}\n}}\n")
        J.index_sources(spark, str(tmp_path / repo), repo, store)
    found = {r.repo: r.result for r in J.search_text(store, "mark7x").collect()}
    assert found == {repo: f"C7.sol:2:    // mark7x of {repo}" for repo in ("007", "b")}
    assert {r.repo: r.result for r in J.search_text(store, "of 007").filter(F.col("repo") == "b").collect()} == {"b": "(no matches)"}
    near = P.only_candidates(store.get("sources"), store.get("trigrams"), "mark7x")
    assert near.count() == 2
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "In(path, [C7.sol])" in plan or "EqualTo(path,C7.sol)" in plan
    plan = P.candidate_files(store.get("trigrams"), "mark7x")._jdf.queryExecution().executedPlan().toString()
    assert "In(trigram, [" in plan
