"""From files of two repositories to tables, contexts and a report."""

import json

from pyspark.sql import functions as F

from auditjobs.jobs import files as J
from auditjobs.operators import context
from auditjobs.operators.replies import SUBMISSION_PREFIX
from auditjobs.sources.files import read_report

VAULT = """pragma solidity ^0.8.1;
contract Vault is Base {
    Token public token;
    function withdraw(uint amount) external {
        token.transfer(amount);
        total = amount;
    }
}
contract Base {
    function base() public {
    }
}
"""


def detector(check, function, lines):
    at = {"filename_relative": "src/Vault.sol", "lines": lines}
    node = {"type": "function", "name": function, "source_mapping": at, "type_specific_fields": {"parent": {"type": "contract", "name": "Vault", "source_mapping": {"lines": []}}}}
    return {"check": check, "impact": "High", "confidence": "Medium", "description": f"{check} in {function}", "elements": [node]}


def files_of(root, token):
    """Writes a repository's source tree, report, log and blame."""
    (root / "tree/src").mkdir(parents=True)
    (root / "tree/lib").mkdir()
    (root / "tree/src/Vault.sol").write_text(VAULT)
    (root / "tree/src/Token.sol").write_text(f"contract {token} {{\n    function transfer(uint a) public {{\n    }}\n}}\n")
    (root / "tree/lib/Skipped.sol").write_text("contract Skipped {\n}\n")
    found = [detector("reentrancy-eth", "withdraw", [5, 6]), detector("pragma", "withdraw", [1]), detector("unused-return", "withdraw", [5])]
    (root / "report.json").write_text(json.dumps({"success": True, "results": {"detectors": found}}))
    commit = lambda n, day, message: f"\x1e{n:040d}\n{n:07d}\ndev{n}\n2024-05-{day:02d}T10:00:00+02:00\n{message}\n\n3\t1\tsrc/Vault.sol\n-\t-\tlogo.png"
    (root / "log").write_text("\n".join([commit(1, 1, "First"), commit(2, 20, "Fix overflow"), commit(3, 25, "Refactor vault")]))
    (root / "blame").mkdir()
    (root / "blame/Vault.sol.blame").write_text(f"{1:040d} 1 1 2\nauthor Ann\nauthor-time 0\n\tpragma\n{1:040d} 2 2\n\tcontract\n")


def test_files_to_report(spark, tmp_path):
    store = J.Store(spark, str(tmp_path / "store"))
    for repo, token in (("007", "Token"), ("two/x y", "Other")):
        files_of(tmp_path / repo[:3], token)
        J.index_sources(spark, str(tmp_path / repo[:3] / "tree"), repo, store)
        J.index_history(spark, str(tmp_path / repo[:3] / "log"), repo, store)
        J.index_blame(spark, str(tmp_path / repo[:3] / "blame"), repo, store)
        J.read_findings(spark, str(tmp_path / repo[:3] / "report.json"), repo, store)
    assert sorted(x.name for x in (tmp_path / "store/contracts").glob("repo=*")) == ["repo=007", "repo=two%2Fx%20y"]
    assert {(r.repo, r.name) for r in store.get("contracts").collect()} == {("007", "Vault"), ("007", "Base"), ("007", "Token"), ("two/x y", "Vault"), ("two/x y", "Base"), ("two/x y", "Other")}
    edges = {(r.repo, r.dst) for r in store.get("call_edges").filter("is_external").collect()}
    assert edges == {("007", "Token.transfer"), ("two/x y", "token.transfer")}
    assert store.get("numstat").filter("repo = '007' and path = 'logo.png' and insertions = 0").count() == 3
    assert store.get("blame").groupBy("author").count().collect()[0]["count"] == 4

    contexts = J.assemble_contexts(store, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"), batch_size=1).collect()
    assert sorted((r.repo, r.batch, r.batches) for r in contexts) == [("007", 1, 2), ("007", 2, 2), ("two/x y", 1, 2), ("two/x y", 2, 2)]  # pragma is not worth acting on
    text = next(r.context for r in contexts if r.repo == "007" and "reentrancy-eth" in r.context)
    for part in ("=== Source: src/Vault.sol ===", ">>>    5 |         token.transfer(amount);", "withdraw", "=== Base (contract)", "-> Token.transfer [external]", "Potential reentrancy paths:", "Fix overflow", "Refactor vault", "Commits: 3"):
        assert part in text
    assert "Token.transfer" not in next(r.context for r in contexts if r.repo == "two/x y")

    ids = {(r.repo, r.check_type): r.id for r in store.get("findings").collect()}
    (tmp_path / "replies").mkdir()
    for batch, key in enumerate((("007", "reentrancy-eth"), ("two/x y", "unused-return"))):
        told = {"finding_ids": [ids[key]], "reasons": {ids[key]: "seen"}, "exploit_scenarios": {ids[key]: "drain it"}}
        (tmp_path / f"replies/{batch}.txt").write_text(SUBMISSION_PREFIX + json.dumps(told))
    assert J.read_verdicts(spark, str(tmp_path / "replies"), store).filter("is_true_positive").count() == 2
    J.report(store, str(tmp_path / "report"))
    texts = {r.repo: r.text for r in read_report(spark, str(tmp_path / "report")).collect()}
    assert set(texts) == {"007", "two/x y"} and "## 1. reentrancy-eth" in texts["007"] and "drain it" in texts["007"] and "## 2." not in texts["007"]


def test_a_repository_again_replaces_only_itself(spark, tmp_path):
    store = J.Store(spark, str(tmp_path / "store"))
    for repo in ("a", "b"):
        files_of(tmp_path / repo[:3], "Token")
        J.index_sources(spark, str(tmp_path / repo[:3] / "tree"), repo, store)
    (tmp_path / "a/tree/src/Vault.sol").write_text("contract New {\n}\n")
    J.index_sources(spark, str(tmp_path / "a/tree"), "a", store)
    assert {(r.repo, r.name) for r in store.get("contracts").collect()} == {("a", "New"), ("a", "Token"), ("b", "Vault"), ("b", "Base"), ("b", "Token")}


def test_contexts_join_tables_by_contract_without_exchange(spark, tmp_path):
    store = J.Store(spark, str(tmp_path / "store"))
    files_of(tmp_path / "a", "Token")
    J.index_sources(spark, str(tmp_path / "a/tree"), "a", store)
    J.read_findings(spark, str(tmp_path / "a/report.json"), "a", store)
    given = store.get("findings"), store.get("contracts"), store.get("functions")
    wanted, functions, texts = J.by_contract(store, *given, buckets=3)
    plain = J.by_contract(store, *given, buckets=3, hot=2)
    assert plain == (given[0], given[2], None)  # three findings of one contract
    rows = lambda df: sorted(map(str, df.collect()))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    held = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        found = context.finding_contracts(wanted, texts)
        assert "Exchange" not in plan(found) and "SortMergeJoin" in plan(found)
        assert rows(found) == rows(context.finding_contracts(given[0], context.contract_text(given[1], given[2]))) and len(rows(found)) == 3
        own = lambda f, g: f.select("id", "repo", "contract", F.col("function").alias("name")).join(g.select("repo", "contract", "name", "storage_writes"), ["repo", "contract", "name"])
        assert "Exchange" not in plan(own(wanted, functions)) and rows(own(wanted, functions)) == rows(own(given[0], given[2]))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    again, _, _ = J.by_contract(store, given[0].limit(0), given[1], given[2], buckets=5)  # no findings, other buckets, same place
    assert again.count() == 0
