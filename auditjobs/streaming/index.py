"""Incremental indexing of arriving source files: state per file, changes per contract, tables that apply them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spans import contract_spans
from ..operators.extract import extract_calls, extract_functions, extract_storage_access, latest_definition
from ..operators.graph import build_edges, build_terms

#: An arriving file: its version grows with each change; null content says that the file is gone.
FILES = "repo string, path string, version long, content string"
#: A change of one contract of one file; removals have no facts.
CHANGES = "repo string, path string, version long, change string, name string, contract_type string, inherits array<string>, line_start int, line_end int, body string"
#: What is remembered of a file: its version, and the digest of each contract that it holds.
STATE = "version long, names array<string>, digests array<string>"
INSERT, REMOVE = "insert", "remove"
TABLES = ("contracts", "functions", "terms", "edges")
#: Batches after which the tables are rewritten without what is no longer true.
COMPACT_EVERY = 20


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the newest arrived version of a file changes; versions not above the known one change nothing."""
    known, names, digests = state.get if state.exists else (None, [], [])
    newest = None
    for frame in frames:
        for version, content in zip(frame["version"], frame["content"]):
            found = (int(version), "" if content is None else content, content is not None)
            newest = found if newest is None or found > newest else newest
    if newest is None or (known is not None and newest[0] <= known):
        return
    version, text, there = newest
    held, now, rows = dict(zip(names, digests)), {}, []
    for span in contract_spans(text) if there else ():  # of equal names the last counts
        now[span[0]] = span
    told = {name: hashlib.sha256(repr(span).encode()).hexdigest() for name, span in now.items()}
    for name in sorted(held.keys() - now.keys()):
        rows.append((*key, version, REMOVE, name, None, None, None, None, None))
    for name, (_, kind, parents, first, last, body) in sorted(now.items()):
        if held.get(name) != told[name]:
            rows.append((*key, version, INSERT, name, kind, parents, first, last, body))
    state.update((version, list(told), list(told.values())))
    columns = [c.split()[0] for c in CHANGES.split(", ")]
    if rows:
        yield pd.DataFrame(rows, columns=columns).astype({"line_start": "Int32", "line_end": "Int32"})


def contract_changes(files: DataFrame) -> DataFrame:
    """Inserts and removals of contracts by arriving files (repo, path, version, content), as a stream.

    State is kept per (repo, path): a version and a digest a contract, never text. A contract that is as before
    makes no row; one that left its file is removed, as are all of a file whose content is null. Late older versions are passed over.
    """
    rows = files.select("repo", "path", F.col("version").cast("long").alias("version"), "content")
    return rows.groupBy("repo", "path").applyInPandasWithState(_changes, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)


def facts(changes: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that changes add: contracts with their change; functions, terms and edges of inserts, with path and version."""
    new = changes.filter(F.col("change") == INSERT)
    functions = extract_storage_access(extract_calls(extract_functions(new)))
    stamp = new.select("repo", F.col("name").alias("contract"), "path", "version")
    # a batch has one insert at most for a file's contract: rows of a contract name may come from several files
    parts = []
    for name, df in (("functions", functions.drop("body")), ("terms", _of_file(build_terms, new, functions)), ("edges", _of_file(build_edges, new, functions))):
        parts.append((name, df.join(stamp, ["repo", "contract", "path"])))
    return {"contracts": changes, **dict(parts)}


def _of_file(build, contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """Terms or edges with contract and path: built as for one repository a file, so that equal names of two files stay apart."""
    apart = lambda df: df.withColumn("repo", F.struct("repo", "path"))
    rows = build(apart(contracts), apart(functions))
    rows = rows.withColumn("path", F.col("repo.path")).withColumn("repo", F.col("repo.repo"))
    return rows if "contract" in rows.columns else rows.withColumn("contract", F.col("source"))


class IndexTables:
    """Tables of contracts, functions, terms and edges in a shared folder, to which batches of changes are applied.

    A batch writes folders of its own number, so that one that is run again after a failure replaces itself. Readers take the last
    whole base and the batches after it; the newest change of a file's contract decides whether its rows count. Every
    ``compact_every`` batches a new base has only rows that count; it is in use once its mark is written, last of all.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = COMPACT_EVERY):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _numbers(self, folder: str) -> list[int]:
        """The numbers in the names of what the folder holds: one a batch or base, few since compaction removes them."""
        path = self._path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName().rpartition("=")[2]) for x in fs.listStatus(path)) if fs.exists(path) else []

    def _drop(self, *parts: str) -> None:
        path = self._path(*parts)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Add a batch of changes; the contracts' folder comes last and makes the batch count."""
        held = changes.persist()
        try:
            rows = facts(held)
            for name in reversed(TABLES):
                rows[name].write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")
        finally:
            held.unpersist()
        base = max(self._numbers("base"), default=-1)
        if len([n for n in self._numbers("contracts") if n > base]) >= self.compact_every:
            self.compact(batch)

    def _rows(self, name: str) -> DataFrame | None:
        base = max(self._numbers("base"), default=None)
        whole = sorted(n for n in self._numbers("contracts") if base is None or n > base)
        paths = ([f"{self.root}/base/n={base}/{name}"] if base is not None else []) + [f"{self.root}/{name}/batch={n}" for n in whole]
        return self.spark.read.parquet(*paths) if paths else None

    def _true(self) -> dict[str, DataFrame] | None:
        """All rows that count, of all files: those of the newest change of each file's contract, if that is an insert."""
        contracts = self._rows("contracts")
        if contracts is None:
            return None
        newest = contracts.groupBy("repo", "path", "name").agg(F.max_by("change", "version").alias("change"), F.max("version").alias("version")).filter(F.col("change") == INSERT)
        out = {"contracts": contracts.join(newest.drop("change"), ["repo", "path", "name", "version"], "left_semi").filter(F.col("change") == INSERT)}
        own = newest.select("repo", "path", F.col("name").alias("contract"), "version")
        for name in TABLES[1:]:
            out[name] = self._rows(name).join(own, ["repo", "path", "contract", "version"], "left_semi")
        return out

    def compact(self, batch: int) -> None:
        """Write a base of the rows that count up to this batch, and delete what it replaces."""
        before = self._numbers("base")
        for name, rows in self._true().items():
            rows.write.mode("overwrite").parquet(f"{self.root}/making/{name}")
        target, making = self._path("base", f"n={batch}"), self._path("making")
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        fs.rename(making, target)  # whole or not at all
        for name in TABLES:
            for n in self._numbers(name):
                if n <= batch:
                    self._drop(name, f"batch={n}")
        for n in before:
            if n != batch:
                self._drop("base", f"n={n}")

    def read(self) -> dict[str, DataFrame]:
        """contracts, functions, terms and edges of the latest definition of each contract: the newest version, then the last path."""
        rows = self._true()
        if rows is None:
            raise FileNotFoundError(f"no batch has been applied to {self.root}")
        latest = latest_definition(rows["contracts"], ["repo", "name"], ["version", "path", "line_start"])
        own = latest.select("repo", "path", F.col("name").alias("contract"))
        return {"contracts": latest.drop("change")} | {name: rows[name].join(own, ["repo", "path", "contract"], "left_semi") for name in TABLES[1:]}


def stream_index(files: DataFrame, tables: IndexTables, checkpoint: str, **trigger) -> StreamingQuery:
    """Index a stream of files (repo, path, version, content) into tables. Restarted with the same checkpoint it goes on where it stopped.

    A batch whose tables were written but not noted is run again from the same state and writes the same folders.
    """
    writer = contract_changes(files).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(tables.apply)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
