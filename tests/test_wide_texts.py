"""What is shuffled or broadcast where texts are wide."""

from contextlib import contextmanager

from auditjobs.operators import calls as C
from auditjobs.operators import context as X
from auditjobs.sources.scratch import cut


@contextmanager
def broadcasts_up_to(spark, size):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def exchanges(df):
    """(name, columns) of all exchanges of the plan as it begins."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.initialPlan())
        if "Exchange" in name:
            found.append((name, {node.output().apply(i).name() for i in range(node.output().size())}))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def index(spark):
    """Functions of contracts A, A.b and S: names with dots make A.b.c of two of them."""
    columns = "repo string, contract string, name string, parameters array<string>, calls array<string>, storage_reads array<string>, storage_writes array<string>"
    functions = spark.createDataFrame(
        [("r", "A", "b.c", [], ["f", "x.y"], ["v"], ["v", "w"]), ("r", "A.b", "c", [], ["c"], [], []), ("r", "A", "f", [], ["b.c", "f"], ["v"], []), ("r", "S", "g", ["A a"], ["a.f"], ["w"], ["w"])], columns
    )
    contracts = spark.createDataFrame([("r", "A"), ("r", "A.b"), ("r", "S")], "repo string, name string")
    return contracts, functions


def findings(spark):
    asked = [("1", "A", "b.c"), ("2", "A.b", "c"), ("3", "S", "g"), ("4", "A", "b.c"), ("5", "A", "none"), ("6", "", "f"), ("7", None, "f"), ("8", "A", "f")]
    return spark.createDataFrame([(i, "r", c, f) for i, c, f in asked], "id string, repo string, contract string, function string")


def test_call_context_leaves_chains_where_they_are_made(spark):
    contracts, functions = index(spark)
    variables = spark.createDataFrame([], "repo string, contract string, var string, var_type string")
    with broadcasts_up_to(spark, -1):
        rows = X.finding_call_context(findings(spark), C.call_edges(functions, variables, contracts), functions, 3)
        assert [x for x in exchanges(rows) if "chain" in x[1]] == []
        found = {r.id: r.content for r in rows.collect()}
    assert sorted(found) == ["1", "2", "3", "4", "5", "8"] and found["1"] == found["4"] != found["2"]
    assert "Potential reentrancy paths:\n  A.b.c -> " in found["1"] and "Potential" not in found["2"]
    assert found["5"].endswith("Call chain from A.none:\n  (leaf)\n\nPotential reentrancy paths:\n  A.b.c -> x.y")
    assert "\n\nBreaking change impact:\n  A.b.c (internal)" in found["8"]


def test_flow_context_broadcasts_no_functions(spark):
    functions = cut(index(spark)[1])
    edges = spark.createDataFrame([("r", "S", "A")], "repo string, source string, target string")
    rows = X.finding_flow_context(cut(findings(spark)), functions, C.storage_flows(functions, edges))
    # sizes of parsed tables are unknown when plans are made, so neither side of their join with findings may be sent whole
    assert [x for x in exchanges(rows) if x[0].startswith("Broadcast") and ("storage_reads" in x[1] or {"id", "name"} <= x[1])] == []
    found = {r.id: r.content for r in rows.collect()}
    assert sorted(found) == ["1", "2", "3", "4", "8"]
    assert found["1"] == "=== Data Flow Context ===\nReads: v\nWrites: v, w\n\nData flow for v:\n  A.b.c -> A.b.c (storage)\n  A.b.c -> A.f (storage)\n\nData flow for w:\n  A.b.c -> S.g (storage)"
    assert found["2"] == "=== Data Flow Context ==="


def test_elements_broadcast_no_texts(spark):
    from auditjobs.jobs import queries as Q

    from .conftest import DATA

    wide = {"content", "head", "functions", "function_lines", "storage_reads", "calls", "levels", "shown", "text"}
    rows = Q._all_elements(spark, DATA)
    assert [x for x in exchanges(rows) if x[0].startswith("Broadcast") and x[1] & wide] == []


def test_packing_writes_no_texts(spark):
    import glob

    from auditjobs.sources.scratch import shared_folder

    rows = [("a", 1, 1.0, 0, 100, "x" * 400), ("a", 1, 0.5, 1, 300, "y" * 1200), ("a", 2, 0.5, 2, 10, "z" * 40), ("b", 1, 1.0, 0, 900, "w" * 3600), ("c", 1, 1.0, 0, 450, "v" * 1800), ("c", 1, 1.0, 1, 100, "u" * 400)]
    elements = spark.createDataFrame(rows, "id string, priority int, relevance double, seq int, tokens int, content string")
    folder = shared_folder(spark).removeprefix("file:")
    old = set(glob.glob(f"{folder}/cut-*"))
    packed = X.pack_context(elements, 350)
    found = {r.id: (r.context, r.used) for r in packed.collect()}
    assert set(glob.glob(f"{folder}/cut-*")) == old
    assert len([x for x in exchanges(packed) if x[1] & {"content", "text"}]) == 1
    end = "\n... (context truncated)"
    assert found == {"a": ("x" * 400 + "\n\n" + "y" * 1000 + end, 100), "b": ("w" * 1400 + end, 0), "c": ("v" * 1400 + end, 0)}
    assert {r.id: (r.context, r.used) for r in X.pack_context(elements, 100).collect()} == {"a": ("x" * 400, 100), "b": ("", 0), "c": ("", 0)}
    assert {r.id: r.used for r in X.pack_context(elements, 0).collect()} == {"a": 410, "b": 900, "c": 550}
