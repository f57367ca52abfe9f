"""The incremental index: what leaves a file leaves the tables, over restarts, late versions, failures and compaction."""

import os

import pytest

from auditjobs.operators import extract, graph
from auditjobs.sources import files as S
from auditjobs.streaming.index import CHANGES, FILES, IndexTables, contract_changes, stream_index

A1 = "contract A is Base {\n    using L for uint;\n    Token public token;\n    function pay() public {\n        token.send(1);\n    }\n}\ncontract B {\n    function old() public {\n        x.y();\n    }\n}"
A2 = "contract A is Base {\n    using L for uint;\n    Token public token;\n    function pay() public {\n        token.send(1);\n    }\n}"
A3 = "contract A {\n    function other() public {\n        z.w();\n    }\n}"
C1 = "library C {\n    function c() public {\n    }\n}"


class Feed:
    def __init__(self, spark, root, compact_every=20):
        self.spark, self.root = spark, str(root)
        self.tables = IndexTables(spark, f"{root}/tables", compact_every)

    def put(self, *rows):
        self.spark.createDataFrame([("r", *row) for row in rows], FILES).coalesce(1).write.mode("append").parquet(f"{self.root}/in")
        return self

    def run(self, tables=None):
        """One start of the stream with the feed's checkpoint."""
        stream = stream_index(self.spark.readStream.schema(FILES).parquet(f"{self.root}/in"), tables or self.tables, f"{self.root}/checkpoint")
        stream.awaitTermination()
        return self

    def rows(self):
        found = self.tables.read()
        return {
            "contracts": sorted((r.name, r.path, r.version, r.contract_type, tuple(r.inherits), r.line_start, r.line_end) for r in found["contracts"].collect()),
            "functions": sorted((r.contract, r.name) for r in found["functions"].collect()),
            "terms": sorted((r.contract, r.term) for r in found["terms"].collect()),
            "edges": sorted((r.source, r.target, r.edge_type) for r in found["edges"].collect()),
        }


def names(rows):
    return [r[0] for r in rows["contracts"]]


def test_what_leaves_a_file_leaves_the_tables(spark, tmp_path):
    feed = Feed(spark, tmp_path).put(("a.sol", 1, A1), ("c.sol", 1, C1)).run()
    first = feed.rows()
    assert names(first) == ["A", "B", "C"] and ("B", "x", "calls") in first["edges"] and ("B", "old") in first["terms"]
    second = feed.put(("a.sol", 2, A2)).run().rows()  # a new start from the checkpoint
    assert names(second) == ["A", "C"] and all(x[0] != "B" for t in ("functions", "terms", "edges") for x in second[t])
    assert second["contracts"][0] == first["contracts"][0]  # as it was, so not written again: still of version 1
    third = feed.put(("a.sol", 3, A3)).run().rows()
    assert third["edges"] == [("A", "z", "calls")] and ("A", "pay") not in third["functions"]
    assert names(feed.put(("a.sol", 2, A1)).run().rows()) == ["A", "C"]  # late
    assert feed.put(("a.sol", 4, None), ("c.sol", 2, "")).run().rows() == {t: [] for t in third}
    assert names(feed.put(("a.sol", 5, A1)).run().rows()) == ["A", "B"]


def test_equals_the_batch_index(spark, tmp_path):
    versions = [("a.sol", 1, A1), ("b.sol", 1, C1 + "\n" + A3), ("a.sol", 2, A2), ("b.sol", 2, C1)]
    in_steps = Feed(spark, tmp_path / "steps")
    for rows in (versions[:2], versions[2:]):
        in_steps.put(*rows).run()
    at_once = Feed(spark, tmp_path / "once").put(*versions).run()
    strip = lambda rows: {t: [r[:2] + r[3:] if t == "contracts" else r for r in x] for t, x in rows.items()}  # noqa: E731  versions tell when a contract last changed
    assert strip(in_steps.rows()) == strip(at_once.rows())
    sources = spark.createDataFrame([("r", "a.sol", A2), ("r", "b.sol", C1)], "repo string, path string, content string")
    contracts, functions = extract.index(sources)
    assert at_once.rows()["terms"] == sorted((r.contract, r.term) for r in graph.build_terms(contracts, functions).collect())
    assert at_once.rows()["edges"] == sorted((r.source, r.target, r.edge_type) for r in graph.build_edges(contracts, functions).collect())
    assert at_once.rows()["functions"] == sorted((r.contract, r.name) for r in functions.collect())


def test_one_name_in_two_files(spark, tmp_path):
    feed = Feed(spark, tmp_path).put(("a.sol", 1, A2)).run().put(("b.sol", 2, A3)).run()
    assert feed.rows()["contracts"][0][1] == "b.sol" and feed.rows()["edges"] == [("A", "z", "calls")]
    back = feed.put(("b.sol", 3, None)).run().rows()  # then the older file's counts again
    assert back["contracts"][0][1] == "a.sol" and ("A", "token", "calls") in back["edges"]


def test_a_failed_batch_is_applied_once(spark, tmp_path):
    class Failing(IndexTables):
        def apply(self, changes, batch):
            super().apply(changes, batch)
            raise RuntimeError("lost after writing")

    feed = Feed(spark, tmp_path).put(("a.sol", 1, A1)).run().put(("a.sol", 2, A2), ("c.sol", 1, C1))
    with pytest.raises(Exception, match="lost after writing"):
        feed.run(Failing(spark, feed.tables.root))
    again = feed.run().rows()
    assert again == Feed(spark, tmp_path / "plain").put(("a.sol", 1, A1)).run().put(("a.sol", 2, A2), ("c.sol", 1, C1)).run().rows()


def test_compaction(spark, tmp_path):
    tight = Feed(spark, tmp_path / "tight", compact_every=2)
    steps = [("a.sol", 1, A1), ("a.sol", 2, A2)], [("c.sol", 1, C1)], [("a.sol", 3, A3), ("d.sol", 1, A1)], [("d.sol", 2, "")]
    for step in steps:
        tight.put(*step).run()
    root, found = tight.tables.root, tight.rows()
    assert names(found) == ["A", "C"] and found["edges"] == [("A", "z", "calls")]
    assert len(os.listdir(f"{root}/base")) == 1 and len(os.listdir(f"{root}/contracts")) < 2
    tight.tables.apply(spark.createDataFrame([], CHANGES), 99)
    assert found == tight.rows()


def test_only_changes_move(spark, tmp_path):
    feed = Feed(spark, tmp_path).put(("a.sol", 1, A1))
    stream = contract_changes(spark.readStream.schema(FILES).parquet(f"{feed.root}/in"))
    out, seen = f"{feed.root}/out", 0
    for row, new in ((None, 2), (("a.sol", 2, A1), 0), (("a.sol", 3, A2), 1), (("a.sol", 4, A3), 1)):
        if row:
            feed.put(row)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{feed.root}/c2").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).count()
        assert rows - seen == new
        seen = rows
    assert {(r.change, r.name, r.body) for r in spark.read.parquet(out).filter("version = 3").collect()} == {("remove", "B", None)}


def test_files_that_arrive(spark, tmp_path):
    for path, text in {"1/src/a.sol": A1, "2/src/a.sol": A2, "1/lib/x.sol": C1, "2/src/c.sol": C1, "notes/src/n.sol": C1}.items():
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    tables = IndexTables(spark, str(tmp_path / "tables"))
    stream_index(S.read_source_stream(spark, str(tmp_path / "in"), "r"), tables, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r.name, r.path, r.version) for r in tables.read()["contracts"].collect()) == [("A", "src/a.sol", 2), ("C", "src/c.sol", 2)]
