"""Change history: commits, numstat rows, churn, hotspots, authorship."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import commit_summary, contains_any, relative_age
from ..sources.scratch import cut
from .ranked import running

# Words whose presence marks a commit.
SECURITY_KEYWORDS = [
    "fix", "bug", "vulnerability", "security", "exploit", "hack",
    "patch", "emergency", "critical", "reentrancy", "overflow",
    "underflow", "access control", "permission", "auth", "bypass",
    "injection", "dos", "denial", "front-running", "sandwich",
]
RISKY_CHANGE_KEYWORDS = [
    "refactor", "rewrite", "optimize", "simplify", "cleanup",
    "remove", "delete", "deprecate", "upgrade", "migrate",
]

# The headings of a finding's lists from the second on, and the text without lists.
HEADINGS = [
    "",
    "\n=== Recent security-related commits ===\n",
    "\n=== Recent risky changes (refactors, rewrites) ===\n",
    "\n=== Frequently changed files (hotspots) ===\n",
]
NO_HISTORY = "No relevant git context found."

#: Volatility: weights of frequency and recency, and the days over which recency decays.
FREQUENCY_WEIGHT, RECENCY_WEIGHT, DECAY_DAYS = 0.3, 0.7, 90


def parse_commit_log(text: DataFrame, repo_col: str = "repo", record_col: str = "record") -> DataFrame:
    """Records of hash, short hash, author, ISO date and subject lines, then numstat lines. Malformed records go.

    The date's offset is dropped, not converted. A record's statistics are its own.
    """
    lines = F.split(F.trim(F.col(record_col)), "\n")
    at = lambda i: F.trim(F.get("lines", F.lit(i)))
    rows = text.select(repo_col, lines.alias("lines"))
    stats = F.filter(F.slice("lines", 6, F.greatest(F.size("lines") - 5, F.lit(0))), lambda x: F.size(F.split(x, "\t")) >= 3)
    return (
        rows.select(
            repo_col,
            at(0).alias("hash"),
            at(1).alias("short_hash"),
            at(2).alias("author"),
            F.substring(at(3), 1, 19).try_cast("timestamp_ntz").alias("date"),
            at(4).alias("message"),
            at(4).contains("Merge").alias("is_merge"),
            stats.alias("stats"),
        )
        .filter(F.col("date").isNotNull() & F.col("message").isNotNull())
    )


def _stat(column: Column, i: int) -> Column:
    part = F.get(F.split(column, "\t"), F.lit(i))
    return F.when(part == "-", F.lit(0).cast("long")).otherwise(part.try_cast("long"))


def parse_numstat(lines: DataFrame, line_col: str = "line", *keys: str) -> DataFrame:
    """insertions, deletions, path of tab-separated lines; - (binary) counts as 0; other lines go."""
    c = F.col(line_col)
    return lines.select(*keys, F.get(F.split(c, "\t"), F.lit(2)).alias("path"), _stat(c, 0).alias("insertions"), _stat(c, 1).alias("deletions")).filter(
        "path is not null and insertions is not null and deletions is not null"
    )


def with_totals(commits: DataFrame) -> DataFrame:
    """Parsed commits with files_changed and summed lines from their own statistics."""
    total = lambda i: F.aggregate("stats", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(_stat(x, i), F.lit(0)))
    return commits.select(
        "repo", "hash", "short_hash", "author", "date", "message", "is_merge",
        F.transform("stats", lambda x: F.get(F.split(x, "\t"), F.lit(2))).alias("files_changed"),
        total(0).alias("insertions"), total(1).alias("deletions"),
    )


def recent_commits(commits: DataFrame, as_of: Column, days: int = 30, most: int = 100, numstat: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The newest commits per repository since as_of less ``days`` whole days, with their place; with a path only those that touch it."""
    since = commits.filter(F.col("date") >= F.date_sub(as_of, days).cast("timestamp_ntz"))
    if path is not None:
        since = since.join(numstat.filter(F.col("path") == path).select("repo", "hash").distinct(), ["repo", "hash"], "left_semi")
    return newest(since, ["repo"], most)


def newest(commits: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("date"), "hash")
    return commits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def security_commits(commits: DataFrame, keywords=SECURITY_KEYWORDS) -> DataFrame:
    return commits.filter(contains_any(F.col("message"), keywords))


def risky_commits(commits: DataFrame, keywords=RISKY_CHANGE_KEYWORDS) -> DataFrame:
    return commits.filter(contains_any(F.col("message"), keywords))


def file_history(commits: DataFrame, numstat: DataFrame, paths: DataFrame | None = None, most: int = 50) -> DataFrame:
    """The newest commits that touch each file, with their place; ``paths`` (repo, path) restricts the files."""
    touched = numstat.select("repo", "hash", "path").distinct()
    if paths is not None:
        touched = touched.join(paths.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return newest(touched.join(commits, ["repo", "hash"]), ["repo", "path"], most)


def file_churn(commits: DataFrame, numstat: DataFrame, as_of: Column, days: int = 90, directory: str | None = None) -> DataFrame:
    """Per file in the window: commits, summed lines, last_modified. Rows of one commit add up before the join, so hot files stay small."""
    rows = numstat if directory is None else numstat.filter(F.col("path").startswith(directory.rstrip("/") + "/"))
    per_commit = rows.groupBy("repo", "hash", "path").agg(F.sum("insertions").alias("i"), F.sum("deletions").alias("d"))
    dated = commits.filter(F.col("date") >= F.date_sub(as_of, days).cast("timestamp_ntz")).select("repo", "hash", "date")
    return (
        per_commit.join(dated, ["repo", "hash"])
        .groupBy("repo", "path")
        .agg(
            F.count(F.lit(1)).alias("commits"),
            F.sum("i").alias("total_insertions"),
            F.sum("d").alias("total_deletions"),
            (F.sum("i") + F.sum("d")).alias("total_changes"),
            F.max("date").alias("last_modified"),
        )
    )


def volatility(churn: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """change_frequency (commits a week) and a score from 0 to 1 of frequency and recency."""
    frequency = F.col("commits") / F.lit(days / 7)
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_modified").cast("timestamp"))) / F.lit(86_400_000_000))
    recency = F.when(F.col("last_modified").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - age / F.lit(float(DECAY_DAYS))))
    score = F.when(F.col("commits") > 0, F.least(F.lit(1.0), frequency * FREQUENCY_WEIGHT + recency * RECENCY_WEIGHT)).otherwise(0.0)
    return churn.withColumn("change_frequency", frequency).withColumn("volatility", score)


def hotspots(churn: DataFrame, least: int = 5, most: int | None = None) -> DataFrame:
    """Files with at least ``least`` commits and their place in the repository by score; the first ``most``, else all."""
    rows, order = churn.filter(F.col("commits") >= least), [F.desc("volatility"), "path"]
    if most is not None:  # a limit that each task applies before rows are dealt
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).filter(F.col("place") <= most)
    return running(rows, ["repo"], order, place=F.lit(1)).withColumn("place", F.col("place").cast("int")).drop("place_whole")


#: Lines, and then nodes of lines, that a node of the next level of a file's tree has; levels for 2**32 lines.
FANOUT, LEVELS = 16, 8


def blame_tree(blame: DataFrame) -> DataFrame:
    """repo, path, level, node, author, lines, latest: lines counted per author for every run of FANOUT**level lines that begins at a multiple of it.

    Each level adds up the one below, so that all of them together have little more rows than the lowest.
    """
    level = blame.select("repo", "path", F.col("line").cast("long").alias("node"), "author", "author_time").groupBy("repo", "path", "node", "author")
    level = cut(level.agg(F.count(F.lit(1)).alias("lines"), F.max("author_time").alias("latest")))
    levels = [level.withColumn("level", F.lit(0))]
    while len(levels) < LEVELS and not level.filter(F.col("node") >= FANOUT).isEmpty():
        up = level.groupBy("repo", "path", F.floor(F.col("node") / FANOUT).alias("node"), "author").agg(F.sum("lines").alias("lines"), F.max("latest").alias("latest"))
        level = cut(up)
        levels.append(level.withColumn("level", F.lit(len(levels))))
    return reduce(DataFrame.unionByName, levels).select("repo", "path", "level", "node", "author", "lines", "latest")


def range_nodes(ranges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """ranges with level, node: the fewest nodes of :func:`blame_tree` that make up line_start to line_end, under 2 * FANOUT a level but the last."""
    first, end = F.greatest(F.col("line_start").cast("long"), F.lit(0).cast("long")), F.col("line_end").cast("long") + 1
    # whole nodes of level n within the range begin at from_(n) and stop before to(n)
    from_, to = (lambda n: F.ceil(first / F.lit(FANOUT**n))), (lambda n: F.floor(end / F.lit(FANOUT**n)))
    span = lambda a, b, n: F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda x: F.struct(F.lit(n).alias("level"), x.alias("node"))))
    parts = []
    for n in range(levels):
        a, b, up, down = from_(n), to(n), from_(n + 1), to(n + 1)
        apart = (up < down) if n < levels - 1 else F.lit(False)  # whole parents lie between: only what is on either side of them
        parts += [F.when(apart, span(a, up * FANOUT, n)).otherwise(span(a, b, n)), F.when(apart, span(down * FANOUT, b, n))]
    none = F.array().cast("array<struct<level: int, node: bigint>>")
    rows = ranges.select(*ranges.columns, F.explode(F.concat(*(F.coalesce(x, none) for x in parts))).alias("_x"))
    return rows.select(*ranges.columns, F.col("_x.level").alias("level"), F.col("_x.node").alias("node"))


def blame_share(blame: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per range (repo, path, line_start, line_end) and author: lines, percent of the range, newest time of the range.

    A range meets a file by the nodes of a tree over its lines, some tens for a range of any length, never line by line; so long files
    with many and overlapping ranges make no row a line and range. Repeated ranges are one; ranges with no line have no row.
    """
    key = ["repo", "path", "line_start", "line_end"]
    tree = blame_tree(blame)
    held = tree.agg(F.max("level"), F.max(F.when(F.col("level") == 0, F.col("node")))).first()
    asked = ranges.select(*key).distinct().withColumn("_end", F.col("line_end")).withColumn("line_end", F.least("line_end", F.lit(held[1])))
    met = range_nodes(asked, 1 + (held[0] or 0)).withColumn("line_end", F.col("_end")).join(tree, ["repo", "path", "level", "node"])
    counted = met.groupBy(*key, "author").agg(F.sum("lines").alias("lines"), F.max("latest").alias("latest"))
    whole = Window.partitionBy(*key)
    return counted.select(*key, "author", "lines", (F.col("lines") * 100 / F.sum("lines").over(whole)).alias("percent"), F.max("latest").over(whole).alias("last_modified"))


def repo_stats(commits: DataFrame, as_of: Column) -> DataFrame:
    return commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("total_commits"), F.count_distinct("author").alias("contributors"), F.datediff(as_of, F.min("date")).alias("repo_age_days")
    )


def finding_history(findings: DataFrame, commits: DataFrame, numstat: DataFrame, as_of: Column, window_days: int = 30, churn_days: int = 90, most: int = 5, sizes: bool = False) -> DataFrame:
    """id, section, place, line: history lines of each finding: its file's newest commits, then its repository's security and risky commits and hotspots.

    Repository lists are made once a repository and joined, at most ``most`` rows each. sizes: a file's commits have a
    second line of the lines they changed in it, where they changed any.
    """
    line = F.concat(F.lit("  "), F.col("short_hash"), F.lit(" ("), relative_age(F.col("date"), as_of), F.lit("): "), commit_summary(F.col("message")))
    wanted = findings.select("id", "repo", F.col("location.file").alias("path"))
    own = newest(file_history(commits, numstat, wanted, 10), ["repo", "path"], most).select("repo", "path", "hash", "place", line.alias("line"))
    if sizes:
        changed = numstat.groupBy("repo", "path", "hash").agg(F.sum("insertions").alias("i"), F.sum("deletions").alias("d")).filter("i + d > 0")
        size = F.concat(F.lit("    +"), F.col("i"), F.lit("/-"), F.col("d"), F.lit(" lines"))
        own = own.join(changed, ["repo", "path", "hash"], "left").withColumn("line", F.concat_ws("\n", "line", size))
    files = wanted.join(own, ["repo", "path"]).select("id", F.lit(1).alias("section"), "place", "line")
    recent = recent_commits(commits, as_of, window_days)
    listed = lambda rows, n: newest(rows.drop("place"), ["repo"], most).select("repo", F.lit(n).alias("section"), "place", line.alias("line"))
    hot = hotspots(volatility(file_churn(commits, numstat, as_of, churn_days), as_of, churn_days), 3, most)
    hot_line = F.format_string("  %s: %d changes, volatility=%.2f", "path", "commits", "volatility")
    per_repo = listed(security_commits(recent), 2).unionByName(listed(risky_commits(recent), 3)).unionByName(hot.select("repo", F.lit(4).alias("section"), "place", hot_line.alias("line")))
    return files.unionByName(wanted.select("id", "repo").join(per_repo, "repo").select("id", "section", "place", "line"))


def history_text(findings: DataFrame, commits: DataFrame, numstat: DataFrame, as_of: Column, window_days: int = 30, churn_days: int = 90, most: int = 5) -> DataFrame:
    """id, content: the lines of :func:`finding_history` under headings, one text a finding; a message where there are none.

    Findings of repositories without commits have no text. A finding has 4 * ``most`` lines at most.
    """
    rows = finding_history(findings, commits, numstat, as_of, window_days, churn_days, most, sizes=True)
    lists = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("section", "place", "line"))).alias("xs"))
    wanted = findings.select("id", "repo", F.col("location.file").alias("path")).join(commits.select("repo").distinct(), "repo", "left_semi").join(lists, "id", "left")
    heading = lambda x: F.when(x["section"] == 1, F.concat(F.lit("=== Recent changes to "), "path", F.lit(" ===\n"))).otherwise(F.element_at(F.array(*map(F.lit, HEADINGS)), x["section"]))
    lines = F.transform("xs", lambda x: F.when(x["place"] == 1, F.concat(heading(x), x["line"])).otherwise(x["line"]))
    return wanted.select("id", F.coalesce(F.array_join(lines, "\n"), F.lit(NO_HISTORY)).alias("content"))
