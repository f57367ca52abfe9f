"""Graph operators against plain searches over random graphs."""

import random
from collections import Counter, defaultdict, deque

import pytest

from auditjobs.operators import calls as C
from auditjobs.operators import graph as G


def graph(seed, n=9, m=16):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


def frame(spark, edges, names):
    return spark.createDataFrame([("r", a, b, False) for a, b in edges], f"repo string, {names[0]} string, {names[1]} string, is_external boolean")


def reach(edges, start, depth):
    seen, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        if seen[x] < depth:
            for a, b in edges:
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    queue.append(b)
    return {(start, x, d) for x, d in seen.items() if x != start}


@pytest.mark.parametrize("seed", [1, 2])
def test_closure(spark, seed):
    edges = graph(seed)
    df = frame(spark, edges, ("source", "target"))
    seeds = spark.createDataFrame([("r", f"n{i}") for i in range(10)], "repo string, seed string")
    for depth in (1, 3):
        found = {(r.seed, r.node, r.depth) for r in G.dependencies(df, seeds, depth).collect()}
        assert found == set().union(*(reach(edges, f"n{i}", depth) for i in range(10)))
    back = {(r.seed, r.node) for r in G.dependents(df, seeds, 3).collect()}
    assert back == {(b, a) for i in range(10) for a, b, _ in reach(edges, f"n{i}", 3)}


def simple_paths(edges, at, end, left, path):
    if left <= 0:
        return []
    if at == end:
        return [path + [at]]
    if at in path:
        return []
    return [p for a, b in edges if a == at for p in simple_paths(edges, b, end, left - 1, path + [at])]


@pytest.mark.parametrize("seed", [3, 4])
def test_paths(spark, seed):
    edges = graph(seed, 7, 14)  # with parallel edges, loops and cycles
    df = frame(spark, edges, ("src", "dst"))
    asked = [("n0", "n3"), ("n1", "n1"), ("n2", "n6"), ("n5", "zz")]
    pairs = spark.createDataFrame([("r", a, b) for a, b in asked], "repo string, start string, end string")
    for depth in (1, 3, 6):
        found = sorted(tuple(r.path) for r in G.call_paths(df, pairs, depth).collect())
        assert found == sorted(tuple(p) for a, b in asked for p in simple_paths(edges, a, b, depth, []))
        counts = {(r.start, r.end): int(r.walks) for r in G.path_counts(df, pairs, depth).collect()}
        paths = Counter((p[0], p[-1]) for p in set(found))
        assert all(counts[ends] >= n for ends, n in paths.items())


def test_path_counts_without_cycles(spark):
    layers = [[f"l{i}n{j}" for j in range(5)] for i in range(9)]
    edges = [(a, b) for x, y in zip(layers, layers[1:]) for a in x for b in y] + [("l0n0", "l1n1"), ("s", "l0n0"), ("l8n0", "e"), ("s", "e")]
    pairs = spark.createDataFrame([("r", "s", "e"), ("r", "s", "l3n2"), ("r", "e", "s"), ("r", "s", "s")], "repo string, start string, end string")
    counts = lambda depth: {(r.start, r.end): int(r.walks) for r in G.path_counts(frame(spark, edges, ("src", "dst")), pairs, depth).collect()}
    assert counts(11) == {("s", "e"): 5**7 + 5**6 + 1, ("s", "l3n2"): 25 + 5, ("s", "s"): 1}  # 93,751 paths, none of them expanded
    assert counts(10) == {("s", "e"): 1, ("s", "l3n2"): 30, ("s", "s"): 1}
    assert counts(0) == {}


def chain(edges, start, depth, fanout):
    lines, seen, queue = [f"Call chain from {start}:"], set(), deque([(start, 0)])
    out = defaultdict(list)
    for a, b in sorted(edges):
        out[a].append(b)
    while queue:
        x, d = queue.popleft()
        if x in seen or d > depth:
            continue
        seen.add(x)
        if not out[x]:
            lines.append("  " * (d + 1) + "(leaf)")
        for b in out[x][:fanout]:
            lines.append("  " * (d + 1) + "-> " + b)
            queue.append((b, d + 1))
    return "\n".join(lines)


@pytest.mark.parametrize("seed, fanout", [(5, 5), (6, 2)])
def test_chain(spark, seed, fanout):
    edges = sorted(set(graph(seed, 9, 20)))
    seeds = spark.createDataFrame([("r", f"n{i}") for i in range(10)], "repo string, seed string")
    found = {r.seed: r.chain for r in G.call_chain(frame(spark, edges, ("src", "dst")), seeds, 3, fanout).collect()}
    assert found == {f"n{i}": chain(edges, f"n{i}", 3, fanout) for i in range(10)}


def written_rows(spark, make):
    """The rows of the scratch tables that ``make`` writes."""
    import glob

    from auditjobs.sources.scratch import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    old = set(glob.glob(f"{folder}/cut-*"))
    result = make()
    return result, sum(spark.read.parquet(x).count() for x in set(glob.glob(f"{folder}/cut-*")) - old)


def test_chains_write_no_row_a_seed_and_node(spark):
    edges = [(f"n{i}", f"n{(i * 5 + j) % 60}") for i in range(60) for j in range(5)]
    df = frame(spark, edges, ("src", "dst"))
    seeds = spark.createDataFrame([("r", f"n{i}") for i in range(60)], "repo string, seed string")
    found, rows = written_rows(spark, lambda: {r.seed: r.chain for r in G.call_chain(df, seeds, 3).collect()})
    assert found == {f"n{i}": chain(edges, f"n{i}", 3, 5) for i in range(60)}
    assert rows <= 60 * (5 + 4 + 1)  # edges, nodes near the seeds and pieces; queues of all seeds held 60 nodes each


def test_chain_of_names_with_marks(spark):
    names = ["a\x01", "a", "b\x01bi", "\x01a", "x\ny", "[external]", "-> c", "a\x01b", "\x01i\x01x"]
    edges = sorted({(a, b) for i, a in enumerate(names[:-1]) for b in (names[(i * 2) % 9], names[(i + 4) % 9], names[i])})
    seeds = spark.createDataFrame([("r", x) for x in names + ["alone"]], "repo string, seed string")
    found = {r.seed: r.chain for r in G.call_chain(frame(spark, edges, ("src", "dst")), seeds, 4, 2).collect()}
    assert found == {x: chain(edges, x, 4, 2) for x in names + ["alone"]}


def test_search_both_ways(spark):
    terms = spark.createDataFrame([("r", t, c) for t, c in [("vault", "Vault"), ("vaultfactory", "VaultFactory"), ("v", "V"), ("au", "X")]], "repo string, term string, contract string")
    queries = spark.createDataFrame([("Vault",), ("v",), ("zzz",), ("",)], "query string")
    found = {}
    for r in G.search(terms, queries).orderBy("query", "place").collect():
        found.setdefault(r.query, []).append(r.contract)
    assert found["Vault"] == ["Vault", "V", "VaultFactory", "X"]
    assert found["v"] == ["V", "Vault", "VaultFactory"]
    assert "zzz" not in found


def test_resolution_order(spark):
    functions = spark.createDataFrame(
        [("r", "A", "f", ["Token t", "IPool pool"], ["t.go", "m.go", "pool.get", "x.y", "f", "gone"])],
        "repo string, contract string, name string, parameters array<string>, calls array<string>",
    )
    variables = spark.createDataFrame([("r", "A", "m", "mapping(address => Pool)")], "repo string, contract string, var string, var_type string")
    contracts = spark.createDataFrame([("r", "Token"), ("r", "Pool"), ("r", "IPool")], "repo string, name string")
    edges = C.call_edges(functions, variables, contracts)
    assert {(e.dst, e.is_external) for e in edges.collect()} == {("Token.go", True), ("Pool.go", True), ("IPool.get", True), ("x.y", True), ("A.f", False)}
    assert C.resolve_internal_calls(functions, drop_self=True).count() == 0


def test_registered_chains_and_history_are_whole(spark):
    from tests.conftest import DATA

    import __spark_entry__
    from auditjobs.jobs import adapters as A

    queries = __spark_entry__.queries()
    out = defaultdict(list)
    for r in A.adapted(spark, DATA, "calls").collect():
        out[r.src].append((r.dst, r.is_external))

    def expected(start):
        lines, seen, queue = [f"Call chain from {start}:"], set(), deque([(start, 0)])
        while queue:
            x, d = queue.popleft()
            if x in seen or d > 3:
                continue
            seen.add(x)
            if x not in out:
                lines.append("  " * (d + 1) + "(leaf)")
            for b, external in sorted(out.get(x, []))[:5]:
                lines.append("  " * (d + 1) + "-> " + b + (" [external]" if external else ""))
                queue.append((b, d + 1))
        return "\n".join(lines)

    found = {r.seed: r.chain for r in queries["gr_05_call_chain"](spark, DATA).collect()}
    assert found == {x: expected(x) for x in list(out)}
    assert {r.section for r in queries["jn_10_finding_history"](spark, DATA).select("section").distinct().collect()} >= {4}


def walks_of_three(pairs):
    """(start, node, least number of hops) over all starts."""
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    found = set()
    for start in list(out):
        seen, level = {start}, {start}
        for depth in (1, 2, 3):
            level = set().union(*(out.get(x, set()) for x in level)) - seen
            seen |= level
            found |= {(start, x, depth) for x in level}
    return found


def closures(spark, name):
    from tests.conftest import DATA

    import __spark_entry__
    from auditjobs.jobs import adapters as A

    edges = [(r.source, r.target) for r in A.adapted(spark, DATA, "edges").collect()]
    return edges, [tuple(r) for r in __spark_entry__.queries()[name](spark, DATA).collect()]


def test_registered_dependencies_ask_every_node(spark):
    edges, found = closures(spark, "gr_02_dependencies")
    assert sorted(found) == sorted(walks_of_three(edges))
    assert {x for x, _, _ in found} == {a for a, _ in edges}


def test_registered_dependents_ask_every_node(spark):
    edges, found = closures(spark, "gr_03_dependents")
    assert sorted(found) == sorted(walks_of_three([(b, a) for a, b in edges]))
    assert {x for x, _, _ in found} == {b for _, b in edges}


def test_registered_report_asks_every_node(spark):
    edges, found = closures(spark, "gr_06_dependency_report")
    down, up = walks_of_three(edges), walks_of_three([(b, a) for a, b in edges])
    label = lambda x: "(contract)" if x[0] == "S" else "(external)"
    assert sorted(found) == sorted([(a, "depends on", b, label(b)) for a, b, _ in down] + [(a, "used by", b, "") for a, b, _ in up])
