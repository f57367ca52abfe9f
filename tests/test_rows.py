"""History, findings, replies and context on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from auditjobs.functions import text as T
from auditjobs.operators import context as X
from auditjobs.operators import findings as N
from auditjobs.operators import history as H
from auditjobs.operators import replies as R


def record(*lines):
    return "\n".join(lines)


def test_commit_log(spark):
    good = record("a" * 40, "aaa", "Ann", "2024-03-01T10:20:30+09:00", "Merge --- x", "1\t2\tp.sol", "-\t-\timg.png", "no stats here")
    bare = record("b" * 40, "bbb", "Bob", "2024-03-02T00:00:00Z", "Tidy")
    bad = record("c" * 40, "ccc", "Cid", "yesterday", "Fix")
    short = record("d" * 40, "ddd")
    df = spark.createDataFrame([("r", x) for x in (good, bare, bad, short, "")], "repo string, record string")
    found = {r.short_hash: r for r in H.with_totals(H.parse_commit_log(df)).collect()}
    assert set(found) == {"aaa", "bbb"}
    assert found["aaa"].date == datetime.datetime(2024, 3, 1, 10, 20, 30)
    assert found["aaa"].is_merge and not found["bbb"].is_merge
    assert (found["aaa"].files_changed, found["aaa"].insertions, found["aaa"].deletions) == (["p.sol", "img.png"], 1, 2)
    assert (found["bbb"].files_changed, found["bbb"].insertions) == ([], 0)


def test_volatility_bounds(spark):
    as_of = F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([(0, None), (100, "2024-03-31 00:00:00"), (1, "2020-01-01 00:00:00"), (1, None)], "commits long, last string").withColumn("last_modified", F.col("last").cast("timestamp_ntz"))
    scores = [r.volatility for r in H.volatility(df, as_of).collect()]
    assert scores[0] == 0.0 and scores[1] == 1.0
    assert scores[2] == pytest.approx(0.3 / (90 / 7)) and scores[3] == pytest.approx(0.3 / (90 / 7) + 0.7)


@pytest.mark.parametrize("days, text", [(0, "today"), (1, "yesterday"), (6, "6 days ago"), (7, "1 weeks ago"), (29, "4 weeks ago"), (30, "1 months ago")])
def test_relative_age(spark, days, text):
    now = datetime.datetime(2024, 5, 1, 12)
    df = spark.createDataFrame([(now - datetime.timedelta(days=days), now)], "d timestamp_ntz, n timestamp_ntz")
    assert df.select(T.relative_age(F.col("d"), F.col("n"))).first()[0] == text


def test_truncate_and_cap(spark):
    df = spark.createDataFrame([("abcdefghij",), ("abc",), (None,)], "c string")
    assert [r[0] for r in df.select(T.truncate_text(F.col("c"), 8, "..")).collect()] == ["abcdef..", "abc", None]
    assert [r[0] for r in df.select(T.cap_text(F.col("c"), 8, "..")).collect()] == ["abcdefgh..", "abc", None]


def test_report_shapes(spark):
    reports = ['{"success": true, "results": {}}', '{"success": false, "results": {"detectors": [{}]}}', '{"success": true, "results": {"detectors": [{"check": "x", "elements": []}, {}]}}', "broken", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reports)], "key int, report string")
    found = N.normalize_findings(N.detectors_of(df, ["key"]), ["key", "place"], ["key", "place"]).collect()
    assert [(f.key, f.place, f.check_type, f.severity, f.contract, f.location.file, f.location.line_start) for f in found] == [(2, 0, "x", "", "", "", None), (2, 1, "", "", "", "", None)]
    assert len({f.id for f in found}) == 2


def test_verdicts_later_batch_wins(spark):
    findings = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = [(1, "a", True, "one", "s"), (2, "a", False, "two", None), (1, "zz", True, "none", None)]
    submissions = spark.createDataFrame(rows, "batch int, finding_id string, confirmed boolean, reason string, exploit_scenario string")
    found = {r.finding_id: tuple(r)[1:] for r in N.merge_verdicts(findings, submissions).collect()}
    assert found == {"a": (True, "two", "s"), "b": (False, "", "")}
    counts = N.verdict_counts(findings, N.merge_verdicts(findings, submissions)).first()
    assert tuple(counts) == (2, 1, 1)


def test_batches(spark):
    df = spark.createDataFrame([("r", i) for i in range(23)], "repo string, id int")
    found = N.assign_batches(df, ["id"], 10).orderBy("id").collect()
    assert [r.batch for r in found] == [i // 10 + 1 for i in range(23)] and {r.batches for r in found} == {3}


@pytest.mark.parametrize(
    "raw, json", [("```json\n{1}\n```", "{1}"), ("```\n x \n```", "x"), ("so {a} and {b}", "{a}"), ("  plain ", "plain"), (None, ""), ("{open", "{open")]
)
def test_reply_json(spark, raw, json):
    assert R.extract_json_reply(spark.createDataFrame([(raw,)], "raw string")).first().json == json


def test_fenced_code(spark):
    df = spark.createDataFrame([("```solidity\n a \n```",), ("```\nb```",), ("```python\nc```",), (None,)], "raw string")
    assert [r.code for r in R.extract_fenced_code(df).collect()] == ["a", "b", "", ""]


def test_broken_replies(spark):
    df = spark.createDataFrame([(1, R.SUBMISSION_PREFIX + "{oops"), (2, "other"), (3, R.SUBMISSION_PREFIX + ' {"finding_ids": ["a"], "reasons": {"b": "x"}}')], "k int, raw string")
    found = {(r.k, r.finding_id): (r.confirmed, r.reason) for r in R.parse_submissions(df, ["k"]).collect()}
    assert found == {(3, "a"): (True, None), (3, "b"): (False, "x")}


def elements(spark, sizes):
    rows = [("x", i, str(i) * (4 * n), 1, "s", n, 0.5) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "id string, seq int, content string, priority int, source string, tokens int, relevance double")


@pytest.mark.parametrize(
    "sizes, budget, parts",
    [
        ([100, 200], 300, [400, 800]),  # exact fit
        ([100, 500], 300, [400]),  # 200 remain: dropped
        ([99, 500], 300, [396, 804 + len("\n... (context truncated)")]),  # 201 remain: cut
        ([100, 500, 10], 300, [400]),  # nothing after the overflow
        ([100, 500], 0, [400, 2000]),  # no budget
    ],
)
def test_budget(spark, sizes, budget, parts):
    row = X.pack_context(elements(spark, sizes), budget).first()
    assert [len(p) for p in row.context.split("\n\n")] == parts
    assert budget == 0 or row.used <= budget


def test_context_is_the_same_in_any_partitioning(spark):
    df = elements(spark, [50, 60, 70, 300])
    assert X.pack_context(df.repartition(3), 150).collect() == X.pack_context(df.coalesce(1), 150).collect()


def test_path_suffix(spark):
    findings = spark.createDataFrame([("1", "r", "src/A.sol"), ("2", "r", "A.sol"), ("3", "r", "none.sol"), ("4", "r", "")], "id string, repo string, file string").select("id", "repo", F.struct("file").alias("location"))
    sources = spark.createDataFrame([("r", "lib2/src/A.sol"), ("r", "src/A.sol"), ("r", "src/BA.sol")], "repo string, path string")
    assert {(r.id, r.path) for r in X.match_paths(findings, sources).collect()} == {("1", "src/A.sol"), ("2", "lib2/src/A.sol")}


def test_grep_cap_and_none(spark):
    sources = spark.createDataFrame([("r", "a.sol", "x\nhit 1\nhit 2"), ("q", "b.sol", "x"), ("r", "d/c.txt", "hit 3")], "repo string, path string, content string")
    found = {r.repo: r.result for r in X.grep(sources, "hit", "*.sol").collect()}
    assert found == {"r": "a.sol:2:hit 1\na.sol:3:hit 2", "q": "(no matches)"}
    assert len(X.grep(sources, "hit", None, 30).filter("repo = 'r'").first().result) == 30


def test_history_text(spark):
    at = datetime.datetime(2024, 3, 1)
    commits = spark.createDataFrame(
        [("r", "h1", "h1", "Ann", at, "Fix overflow"), ("r", "h2", "h2", "Bob", at - datetime.timedelta(days=1), "Refactor"), ("r", "h3", "h3", "Bob", at - datetime.timedelta(days=2), "Docs"), ("bare", "h4", "h4", "Cid", at - datetime.timedelta(days=300), "Docs")],
        "repo string, hash string, short_hash string, author string, date timestamp_ntz, message string",
    ).withColumn("is_merge", F.lit(False))
    numstat = spark.createDataFrame([("r", h, "a.sol", i, d) for h, i, d in (("h1", 3, 1), ("h1", 1, 0), ("h2", 0, 0), ("h3", 0, 2))], "repo string, hash string, path string, insertions int, deletions int")
    findings = spark.createDataFrame([(1, "r", ("a.sol",)), (2, "r", (None,)), (3, "bare", ("a.sol",)), (4, "none", ("a.sol",))], "id int, repo string, location struct<file string>")
    as_of = F.lit("2024-03-01 12:00:00").cast("timestamp_ntz")
    found = {r.id: r.content for r in H.history_text(findings, commits, numstat, as_of).collect()}
    score = min(1, 3 / (90 / 7) * 0.3 + 0.7)
    rest = ["", "=== Recent security-related commits ===", "  h1 (today): Fix overflow", "", "=== Recent risky changes (refactors, rewrites) ===", "  h2 (yesterday): Refactor"]
    rest += ["", "=== Frequently changed files (hotspots) ===", f"  a.sol: 3 changes, volatility={score:.2f}"]
    own = ["=== Recent changes to a.sol ===", "  h1 (today): Fix overflow", "    +4/-1 lines", "  h2 (yesterday): Refactor", "  h3 (2 days ago): Docs", "    +0/-2 lines"]
    assert found == {1: record(*own, *rest), 2: record(*rest), 3: H.NO_HISTORY}
    assert H.history_text(findings.limit(0), commits, numstat, as_of).count() == 0


def test_structure_text(spark):
    findings = spark.createDataFrame([(1, "r"), (2, "r"), (3, "s"), (4, None)], "id int, repo string")
    stats = spark.createDataFrame([("r", 5, 2, 3, 4), ("s", 1, 1, 0, 0)], "repo string, files_indexed long, contracts long, functions long, edges long")
    history = spark.createDataFrame([("r", 7, 2, 10)], "repo string, total_commits long, contributors long, repo_age_days int")
    r = record("=== Project Structure ===", "Contracts: 2", "Functions: 3", "Dependencies: 4")
    s = record("=== Project Structure ===", "Contracts: 1", "Functions: 0", "Dependencies: 0")
    assert {x.id: x.content for x in X.structure_text(findings, stats, history).collect()} == {1: r + "\nCommits: 7\nContributors: 2", 2: r + "\nCommits: 7\nContributors: 2", 3: s}
    assert {x.content for x in X.structure_text(findings, stats).collect()} == {r, s}


def test_whole_context_holds_all_kinds(spark):
    from auditjobs.jobs import queries as Q
    from tests.conftest import DATA

    elements = Q._all_elements(spark, DATA).collect()
    assert {e.source for e in elements} == set(X.KINDS)
    of = {}
    for e in elements:
        of.setdefault(e.id, []).append(e)
    for most in (30_000, 700):
        expected = {}
        for key, parts in of.items():
            used, texts = 0, []
            for e in sorted(parts, key=lambda e: (e.priority, -e.relevance, e.seq)):
                size = len(e.content) // 4
                if used + size > most:
                    if most - used > 200:
                        texts.append(e.content[: 4 * (most - used)] + "\n... (context truncated)")
                    break
                texts.append(e.content)
                used += size
            expected[key] = "\n\n".join(texts), used
        rows = X.pack_context(spark.createDataFrame(elements), most).collect()
        assert {r.id: (r.context, r.used) for r in rows} == expected


@pytest.mark.parametrize("shown", [["id"], ["score", "id"]])
def test_running_totals_over_ranges(spark, shown):
    """One key holds nearly all rows; others hold few, one is null; each has its totals whatever the ranges."""
    from auditjobs.operators.ranked import running

    rows = [(i, None if i % 50 == 0 else "few" if i % 50 == 1 else "hot", (i * 7919) % 1009, i % 13) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, repo string, score int, size int").repartition(5)
    order = [F.desc("score"), "id"] if len(shown) > 1 else ["id"]
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    held = spark.conf.get(adaptive)
    try:
        spark.conf.set(adaptive, "false")  # several ranges, small as they are
        out = running(df, ["repo"], order, place=F.lit(1), run=F.col("size"))
        found = sorted((r.id, r.place, r.place_whole, r.run, r.run_whole) for r in out.collect())
    finally:
        spark.conf.set(adaptive, held)
    assert out.columns == ["id", "repo", "score", "size", "place", "run", "place_whole", "run_whole"]
    expected = []
    for repo in (None, "few", "hot"):
        own = sorted((r for r in rows if r[1] == repo), key=lambda r: r[0] if len(shown) == 1 else (-r[2], r[0]))
        total = 0
        for n, r in enumerate(own):
            total += r[3]
            expected.append((r[0], n + 1, len(own), total, sum(x[3] for x in own)))
    assert found == sorted(expected)
    assert running(df.limit(0), ["repo"], ["id"], place=F.lit(1)).count() == 0
