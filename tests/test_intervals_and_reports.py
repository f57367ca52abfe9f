"""Blame by ranges, blame files that split, and reports of many files."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime

from pyspark.sql import functions as F

from auditjobs.operators import history as H
from auditjobs.sources import files as S

BLAME = "repo string, path string, line int, author string, author_time timestamp_ntz"
RANGES = "repo string, path string, line_start int, line_end int"


def share(rows, ranges):
    out = set()
    for repo, path, a, b in set(ranges):
        own = [(who, t) for r, p, n, who, t in rows if (r, p) == (repo, path) and a <= n <= b]
        for who, n in Counter(w for w, _ in own).items():
            out.add((repo, path, a, b, who, n, round(n * 100 / len(own), 6), max(t for _, t in own)))
    return out


def test_blame_share(spark):
    rng = random.Random(7)
    rows = [("r", p, n, rng.choice("xyz"), datetime(2020, 1, 1 + rng.randrange(28))) for p, size in (("a", 700), ("b", 17), ("c", 1)) for n in range(1, size + 1)]
    rows += [("r", "a", 5, "x", datetime(2021, 1, 1)), ("q", "a", 1, "z", datetime(2019, 1, 1))]
    ranges = [("r", "a", *sorted((rng.randrange(0, 720), rng.randrange(0, 720)))) for _ in range(80)] + [("r", p, a, b) for p in "abc" for a, b in ((1, 1), (1, 16), (16, 32), (1, 10**6), (-5, 3), (9, 4), (256, 511), (255, 512))]
    ranges += [ranges[0], ("q", "a", 1, 9), ("r", "none", 1, 9), ("r", "a", 900, 950)]
    found = H.blame_share(spark.createDataFrame(rows, BLAME), spark.createDataFrame(ranges, RANGES)).collect()
    assert {(*tuple(r)[:6], round(r.percent, 6), r.last_modified) for r in found} == share(rows, ranges)
    assert H.blame_share(spark.createDataFrame([], BLAME), spark.createDataFrame(ranges, RANGES)).count() == 0


def test_a_million_lines_and_thousands_of_ranges(spark):
    lines = spark.range(1, 1_000_001).select(F.lit("r").alias("repo"), F.lit("a").alias("path"), F.col("id").cast("int").alias("line"), F.concat(F.lit("dev"), F.col("id") % 5).alias("author"), F.lit("2020-01-01").cast("timestamp_ntz").alias("author_time"))
    ranges = spark.range(3000).select(F.lit("r").alias("repo"), F.lit("a").alias("path"), (F.col("id") * 100 + 1).cast("int").alias("line_start"), (F.col("id") * 100 + 500_000).cast("int").alias("line_end"))
    nodes = H.range_nodes(ranges)
    assert nodes.count() < 3000 * 2 * H.FANOUT * 5 and nodes.groupBy("line_start").agg(F.sum(F.expr("power(16, level)")).alias("n")).filter("n <> 500000").count() == 0
    found = H.blame_share(lines, ranges)
    assert found.count() == 15000 and found.filter("lines <> 100000 or percent <> 20").count() == 0


def porcelain(rng, n):
    """Porcelain text of n lines, with texts that look like heads or begin with tabs, and (line, hash, author, time)."""
    people = {f"{rng.randrange(16**40):040x}": (f"Ann {i} é", 1_600_000_000 + i) for i in range(30)}
    seen, text, rows = set(), [], []
    for line in range(1, n + 1):
        commit = rng.choice(list(people))
        who, t = people[commit]
        head = f"{commit} {line} {line}" + (" 1" if rng.random() < 0.5 else "")
        if commit not in seen:
            head += f"\nauthor {who}\nauthor-mail <a@b>\nauthor-time {t}\nsummary author of it\nfilename a.sol"
        seen.add(commit)
        odd = rng.choice(["x = 1;", "", "\tdeep", f"{commit} 7 7", "author Eve", "\t", "f" * 400])
        text.append(f"{head}\n\t{odd}")
        rows.append((line, commit, who, t))
    return "\n".join(text) + "\n", rows


def test_one_large_blame_file_is_read_by_many_tasks(spark, tmp_path):
    text, rows = porcelain(random.Random(1), 4000)
    (tmp_path / "A.sol.blame").write_text(text)
    (tmp_path / "B.sol.blame").write_text(porcelain(random.Random(2), 1)[0])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = S.read_blame(spark, str(tmp_path), "r")
        pieces = spark.read.text(str(tmp_path), lineSep=S.BLAME_BREAK)
        assert pieces.rdd.getNumPartitions() > 10 and pieces.select(F.spark_partition_id()).distinct().count() > 10
        got = {(r.line, r.hash, r.author, int(r.author_time.timestamp())) for r in found.filter("path = 'A.sol'").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = S.blame_lines(spark.createDataFrame([("r", "A.sol", text)], "repo string, path string, text string"))
    assert {(r.line, r.hash, r.author) for r in whole.collect()} == {x[:3] for x in got} == {x[:3] for x in rows}
    assert len(got) == len(rows) and found.filter("path = 'B.sol'").count() == 1


def test_a_report_of_many_files(spark, tmp_path):
    entries = [("r one", n, f"t{n}") for n in range(1, 26)] + [("s/2", 1, "only")]
    df = spark.createDataFrame(entries, "repo string, number int, type string").selectExpr("*", "'high' severity", "'Low' difficulty", "'d\n## 7. not an entry' description", "cast(null as string) exploit_scenario", "'' recommendations")
    S.write_report(df.repartition(7), str(tmp_path / "report"), 10)
    told = defaultdict(list)
    for name in (tmp_path / "report" / "manifest").glob("*.json"):
        for line in name.read_text().splitlines():
            row = json.loads(line)
            told[row["repo"]].append((row["part"], row["first"], row["last"], row["entries"]))
    assert {k: sorted(v) for k, v in told.items()} == {"r one": [("00000", 1, 10, 10), ("00001", 11, 20, 10), ("00002", 21, 25, 5)], "s/2": [("00000", 1, 1, 1)]}
    read = {(r.repo, r.part): r.text for r in S.read_report(spark, str(tmp_path / "report")).collect()}
    whole = "".join(read["r one", f"0000{i}"] for i in range(3))
    places = [whole.index(f"## {n}. t{n}\n") for n in range(1, 26)]
    assert places == sorted(places) and whole.startswith("# Solidity Security Audit Report\n") and whole.count(S.REPORT_HEAD[0]) == 1
    assert read["s/2", "00000"].count("## 1. only") == 1


def test_least_name_within(spark):
    from auditjobs.functions.automaton import least_name_within

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    names = {(repo, word(rng.randrange(1, 5))) for repo in ("r", "s") for _ in range(40)} | {("only names", "a")}
    texts = {(repo, word(rng.randrange(0, 12))) for repo in ("r", "s") for _ in range(200)} | {("only texts", "aaa"), ("r", "mapping(address => zz)")}
    want = {(r, t, min(n for q, n in names if q == r and n in t)) for r, t in texts if any(q == r and n in t for q, n in names)}
    frames = spark.createDataFrame(sorted(texts) * 2, "repo string, text string"), spark.createDataFrame(sorted(names), "repo string, name string")
    for sizes in ({}, {"names_each": 3, "texts_each": 17}):
        assert {tuple(r) for r in least_name_within(*frames, **sizes).collect()} == want
