"""Trigrams of files: which files can hold a match of a pattern."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Candidate files up to this many go to the scan as a list of paths, which prunes it; more are joined.
LISTED_FILES = 1000
#: An atom of a pattern (escaped character, class without classes in it, any other character) and how often it stands there.
_ATOM = re.compile(r"(\\.|\[(?!\^?\])(?:\\.|[^\]\\\[])+\]|[^\\])([*+?]|\{\d+(?:,\d*)?\})?[+?]?", re.S)


def required_literals(pattern: str) -> list[list[str]] | None:
    """Texts that a matching line must hold: all of one of the lists. None where the pattern does not tell.

    Only what is sure counts: characters outside groups and classes that stand once at least. Inline flags, quoting and coded characters tell nothing.
    """
    if re.search(r"\(\?[a-zA-Z-]", pattern):
        return None
    branches, run, depth, at = [[]], "", 0, 0
    while at < len(pattern):
        m = _ATOM.match(pattern, at)
        if not m or m[1] == "[" or (m[1][0] == "\\" and m[1][1].isalnum() and m[1][1] not in "dDwWsSbB"):
            return None
        at = m.end()
        atom = m[1]
        depth += (atom == "(") - (atom == ")")
        letter = atom[-1] if len(atom) == 2 and not atom[1].isalnum() else atom
        plain = not depth and (len(atom) == 1 and atom not in "()|^$.*+?{}\n" or len(atom) == 2 and not atom[1].isalnum())
        if plain and m[2] in (None, "+"):
            run += letter
        if not plain or m[2]:
            branches[-1].append(run)
            run = ""
        if atom == "|" and not depth:
            branches.append([])
    branches[-1].append(run)
    told = [[text for text in branch if len(text) > 2] for branch in branches]
    return told if all(told) else None


def trigram_postings(sources: DataFrame) -> DataFrame:
    """trigram, repo, path: each three characters that stand in one line of a file, once a file.

    Lines keep a task's memory at a line's trigrams; repeats go before the shuffle. Store it in order of trigrams, and a reader's filter prunes it.
    """
    lines = sources.select("repo", "path", F.explode(F.split("content", "\n")).alias("line"))
    each = F.array_distinct(F.regexp_extract_all("line", F.lit("(?s)(?=(.{3}))."), F.lit(1)))
    return lines.select(F.explode(each).alias("trigram"), "repo", "path").distinct()


def candidate_files(postings: DataFrame, pattern: str) -> DataFrame | None:
    """repo, path: the files that have all trigrams that a match of the pattern needs; None where all files may match."""
    told = required_literals(pattern)
    if told is None:
        return None
    needed = [sorted({text[i : i + 3] for text in branch for i in range(len(text) - 2)}) for branch in told]
    every = sorted({t for branch in needed for t in branch})
    held = postings.filter(F.col("trigram").isin(every)).groupBy("repo", "path").agg(F.collect_set("trigram").alias("held"))
    some = F.lit(False)
    for branch in needed:
        some = some | (F.size(F.array_except(F.array(*map(F.lit, branch)), "held")) == 0)
    return held.filter(some).select("repo", "path")


def only_candidates(sources: DataFrame, postings: DataFrame, pattern: str) -> DataFrame:
    """The sources that can hold a match, whole; where they were counted and are few, the scan gets their paths."""
    found = candidate_files(postings, pattern)
    if found is None:
        return sources
    listed = found.limit(LISTED_FILES + 1).collect()
    if len(listed) > LISTED_FILES:
        return sources.join(found, ["repo", "path"], "left_semi")
    near = sources.filter(F.col("repo").isin(sorted({r.repo for r in listed})) & F.col("path").isin(sorted({r.path for r in listed})))
    return near.join(F.broadcast(sources.sparkSession.createDataFrame(listed, "repo string, path string")), ["repo", "path"], "left_semi")
