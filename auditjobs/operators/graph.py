"""Dependency graph, closures, paths, call chains, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, shuffled
from .extract import extract_uses


def build_edges(contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """repo, source, target, edge_type, weight, metadata; a bag. Targets of calls are the raw objects."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    edge = lambda source, target, kind, weight, meta: ("repo", F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("edge_type"), F.lit(weight).alias("weight"), meta.alias("metadata"))
    inherits = contracts.select("repo", "name", F.explode("inherits").alias("target")).select(*edge("name", "target", "inherits", 3, none))
    uses = extract_uses(contracts).select(*edge("contract", "name", "uses", 2, none))
    dotted = functions.select("repo", "contract", "name", F.explode("calls").alias("call")).filter(F.col("call").contains("."))
    split = dotted.withColumn("target", F.substring_index("call", ".", 1)).withColumn("method", F.expr("substring(call, length(target) + 2)"))
    calls = split.select(*edge("contract", "target", "calls", 1, F.create_map(F.lit("function"), F.col("name"), F.lit("calls"), F.col("method"))))
    return inherits.unionByName(uses).unionByName(calls)


def dependencies(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """repo, seed, node, depth: all nodes within ``max_depth`` hops of each seed (repo, seed), at their least depth.

    A frontier joined with the distinct edges, less what was seen; each round is written. Hubs are left to AQE.
    """
    hops = cut(edges.select("repo", "source", "target").distinct())
    start = seeds.select("repo", "seed").distinct()
    seen = frontier = cut(start.select("repo", "seed", F.col("seed").alias("node"), F.lit(0).alias("depth")))
    found = []
    for depth in range(1, max_depth + 1):
        step = shuffled(frontier).join(hops, (frontier["repo"] == hops["repo"]) & (frontier["node"] == hops["source"])).select(frontier["repo"], "seed", F.col("target").alias("node")).distinct()
        frontier = cut(shuffled(step).join(seen.select("repo", "seed", "node"), ["repo", "seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found.append(frontier)
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, found) if found else seen.filter("depth > 0")


def dependents(edges: DataFrame, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """The same against the edges."""
    return dependencies(edges.select("repo", F.col("target").alias("source"), F.col("source").alias("target")), seeds, max_depth)


def _levels(hops: DataFrame, ends: DataFrame, ahead: bool, most: int) -> list[DataFrame]:
    """Levels 0 to ``most`` of the walks from each of the ends (repo, of), with or against the edges: repo, of, node, walks.

    Walks that meet in a node of a level are one row with their number, so a level has a row an end and node at most; none comes back to where it began.
    """
    here, there = ("src", "dst") if ahead else ("dst", "src")
    step = hops.select("repo", F.col(here).alias("node"), F.col(there).alias("next"), "times")
    found = [cut(ends.distinct().select("repo", "of", F.col("of").alias("node"), F.lit(1).cast("decimal(38,0)").alias("walks")))]
    while len(found) <= most and not found[-1].isEmpty():
        joined = found[-1].join(step, ["repo", "node"]).filter(F.col("next") != F.col("of"))
        found.append(cut(joined.groupBy("repo", "of", F.col("next").alias("node")).agg(F.sum(F.col("walks") * F.col("times")).cast("decimal(38,0)").alias("walks"))))
    return found


def _layers(call_edges: DataFrame, pairs: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame | None, list[DataFrame], list[DataFrame]]:
    """(edges with their number, arrivals, meetings, levels from the starts, levels from the ends): half the hops from either side.

    arrivals: repo, start, end, hops, walks where the starts' levels reach an end; meetings: repo, start, end, node, walks, rest, more for
    nodes of the starts' last level that are ``rest`` hops from the end, by ``more`` walks. Only here do pairs come in.
    """
    hops = cut(call_edges.select("repo", "src", "dst").filter("src <> dst").groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("times")))
    asked = cut(pairs.select("repo", "start", "end").filter("start <> end").distinct())
    most = max(max_depth - 1, 0)
    half = (most + 1) // 2
    ahead = _levels(hops, asked.select("repo", F.col("start").alias("of")), True, half)
    back = _levels(hops, asked.select("repo", F.col("end").alias("of")), False, most - half)
    placed = lambda levels, least, place: _union([x.withColumn(place, F.lit(n)) for n, x in enumerate(levels) if n >= least])
    if half == 0:
        return hops, asked.limit(0).select("*", F.lit(0).alias("hops"), F.lit(0).cast("decimal(38,0)").alias("walks")), None, ahead, back
    arrivals = asked.join(placed(ahead, 1, "hops").select("repo", F.col("of").alias("start"), F.col("node").alias("end"), "hops", "walks"), ["repo", "start", "end"])
    if len(ahead) <= half or len(back) < 2:
        return hops, arrivals, None, ahead, back
    known = placed(back, 1, "rest").select("repo", F.col("of").alias("end"), "node", "rest", F.col("walks").alias("more"))
    reached = ahead[half].select("repo", F.col("of").alias("start"), "node", "walks")
    met = asked.join(reached, ["repo", "start"]).filter(F.col("node") != F.col("end")).join(known, ["repo", "end", "node"]).filter(F.col("node") != F.col("start"))
    return hops, arrivals, cut(met.select("repo", "start", "end", "node", "walks", "rest", "more")), ahead, back


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def path_counts(call_edges: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """repo, start, end, walks (decimal): the walks of at most ``max_depth`` nodes for each pair that has any.

    It is the number of its paths where no walk meets a node twice, as in graphs without cycles, and never less. Levels from both ends meet
    in the middle; nothing is expanded, so counting costs as much as half the depth, however many walks there are.
    """
    _, arrivals, met, _, _ = _layers(call_edges, pairs, max_depth)
    same = pairs.select("repo", "start", "end").filter("start = end").distinct().withColumn("walks", F.lit(1).cast("decimal(38,0)"))
    found = [same if max_depth > 0 else same.limit(0), arrivals.drop("hops")]
    if met is not None:
        found.append(met.select("repo", "start", "end", (F.col("walks") * F.col("more")).cast("decimal(38,0)").alias("walks")))
    return _union(found).groupBy("repo", "start", "end").agg(F.sum("walks").cast("decimal(38,0)").alias("walks"))


def _grown(seeds: DataFrame, hops: DataFrame, levels: list[DataFrame], ahead: bool) -> DataFrame:
    """Half paths from seeds (repo, start, end, middle, path, times, level) to level 0, one level a step, each on nodes of the levels of its end only."""
    of, other = ("start", "end") if ahead else ("end", "start")
    head, here, there = (F.get("path", F.lit(0)), "dst", "src") if ahead else (F.element_at("path", -1), "src", "dst")
    columns, at = ["repo", "start", "end", "middle", "path", "times"], None
    for n in range(len(levels) - 1, 0, -1):
        new = seeds.filter(F.col("level") == n).select(*columns)
        at = new if at is None else at.unionByName(new)
        step = at.withColumn(here, head).join(hops.withColumnRenamed("times", "more"), ["repo", here]).filter(~F.array_contains("path", F.col(there)) & (F.col(there) != F.col(other)))
        step = step.join(levels[n - 1].select("repo", F.col("of").alias(of), F.col("node").alias(there)), ["repo", of, there])
        path = F.array_prepend("path", F.col(there)) if ahead else F.array_append("path", F.col(there))
        at = cut(step.withColumn("path", path).withColumn("times", F.col("times") * F.col("more")).select(*columns))
    return at


def call_paths(call_edges: DataFrame, pairs: DataFrame, max_depth: int = 10) -> DataFrame:
    """repo, start, end, path: all simple paths of at most ``max_depth`` nodes for each pair (repo, start, end).

    Parallel edges repeat paths; equal ends give the one-node path. A pair has a layered graph: levels of nodes by hops from
    its start and, for the other half of the hops, from its end, shared by all pairs of that start or end and made with the numbers of their walks, nothing
    expanded. Where they meet, half paths grow back to either end along the levels, so every half path is part of a walk between the ends and has half
    the length at most. Two halves that share only their meeting node are a path. :func:`path_counts` tells beforehand how many to expect.
    """
    hops, arrivals, met, ahead, back = _layers(call_edges, pairs, max_depth)
    same = pairs.select("repo", "start", "end").filter("start = end").distinct().select("repo", "start", "end", F.array("start").alias("path"))
    done = [same if max_depth > 0 else same.limit(0)]
    seed = lambda df, node, middle, level: df.select("repo", "start", "end", middle.alias("middle"), F.array(node).alias("path"), F.lit(1).cast("long").alias("times"), level.alias("level"))
    seeds = seed(arrivals, "end", F.lit(None).cast("string"), F.col("hops"))
    if met is not None:
        middles = met.select("repo", "start", "end", "node").distinct()
        seeds = seeds.unionByName(seed(middles, "node", F.col("node"), F.lit(len(ahead) - 1)))
    repeated = lambda df: df.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("repo", "start", "end", "path")
    if len(ahead) > 1:
        first = _grown(seeds, hops, ahead, True)
        done.append(repeated(first.filter("middle is null")))
    if met is not None:
        second = _grown(seed(met, "node", F.col("node"), F.col("rest")), hops, back, False)
        tails = second.select("repo", "start", "end", "middle", F.slice("path", 2, F.size("path")).alias("tail"), F.col("times").alias("more"))
        joined = first.filter("middle is not null").join(tails, ["repo", "start", "end", "middle"]).filter(~F.arrays_overlap("path", "tail"))
        done.append(repeated(joined.withColumn("path", F.concat("path", "tail")).withColumn("times", F.col("times") * F.col("more"))))
    return _union(done)


def first_n_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """At most n rows per key in ``order``, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= n)


#: Marks in a node's piece of a chain: after the node, between its edges, after an external one; and the mark's own character within names.
_HEAD, _NEXT, _EXTERNAL, _SELF = "\x01b", "\x01i", "\x01x", "\x01a"


def _near(seeds: DataFrame, shown: DataFrame, most: int) -> list[DataFrame]:
    """The nodes (repo, node) within 0 to ``most`` shown edges of any seed, each with those before it."""
    found = [cut(seeds)]
    for _ in range(most):
        step = shuffled(found[-1]).join(shown.withColumnRenamed("src", "node"), ["repo", "node"]).select("repo", F.col("dst").alias("node"))
        found.append(cut(found[-1].unionByName(step).distinct()))
    return found


def call_chain(call_edges: DataFrame, seeds: DataFrame, max_depth: int = 3, fanout: int = 5) -> DataFrame:
    """repo, seed, chain: breadth-first text of calls from each seed (repo, seed = contract.function), dealt by (repo, seed).

    A node's first ``fanout`` edges are shown and followed; each node once, at its first turn in the queue, which the
    places of the edges that led to it order; a node without edges is a leaf.

    The queue of a node is that of its edges' nodes, one level shorter, merged in the order of the edges less what stands before: so queues grow
    from the ends, shared by all seeds, one row an edge and round. A node's piece holds its edges without frames; indents come at the end.
    """
    shown = cut(first_n_per_key(call_edges.select("repo", "src", "dst", "is_external"), ["repo", "src"], ["dst", "is_external"], fanout))
    near = _near(seeds.select("repo", F.col("seed").alias("node")).distinct(), shown, max_depth)
    named = lambda c: F.replace(F.col(c), F.lit("\x01"), F.lit(_SELF))
    lines = shown.groupBy("repo", F.col("src").alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", F.concat(named("dst"), F.when(F.col("is_external"), _EXTERNAL).otherwise("")).alias("line")))).alias("xs"))
    joined = shuffled(near[-1]).join(lines, ["repo", "node"], "left")
    piece = F.concat(named("node"), F.lit(_HEAD), F.coalesce(F.array_join(F.transform("xs", lambda x: x["line"]), _NEXT), F.lit("")))
    pieces = cut(joined.select("repo", "node", F.array(F.array(piece)).alias("levels")))
    queues = pieces
    for n in range(1, max_depth + 1):
        asked = near[max_depth - n]
        edges = shuffled(asked).join(shown.select("repo", F.col("src").alias("node"), "place", "dst"), ["repo", "node"]).withColumnRenamed("node", "of").withColumnRenamed("dst", "node")
        below = shuffled(edges).join(queues, ["repo", "node"]).select("repo", F.col("of").alias("node"), "place", "levels")
        own = shuffled(asked).join(pieces, ["repo", "node"]).select("repo", "node", F.lit(0).alias("place"), "levels")
        held = own.unionByName(below).groupBy("repo", "node").agg(F.array_sort(F.collect_list(F.struct("place", "levels"))).alias("xs"))
        rest = F.slice("xs", 2, F.size("xs"))
        level = lambda done, i: F.array_except(F.flatten(F.transform(rest, lambda x: x["levels"][i])), F.flatten(done))
        merged = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.element_at("xs", 1)["levels"], lambda done, i: F.array_append(done, level(done, i)))
        queues = held.select("repo", "node", merged.alias("levels"))

    def framed(piece, depth):
        indent, edges = F.repeat(F.lit("  "), depth + 1), F.substring(piece, F.instr(piece, F.lit(_HEAD)) + len(_HEAD), F.length(piece))
        told = F.replace(F.replace(F.replace(edges, F.lit(_NEXT), F.concat(F.lit("\n"), indent, F.lit("-> "))), F.lit(_EXTERNAL), F.lit(" [external]")), F.lit(_SELF), F.lit("\x01"))
        return F.concat(indent, F.when(edges == "", F.lit("(leaf)")).otherwise(F.concat(F.lit("-> "), told)))

    body = F.array_join(F.flatten(F.transform("levels", lambda x, depth: F.transform(x, lambda piece: framed(piece, depth)))), "\n")
    return queues.select("repo", F.col("node").alias("seed"), F.concat(F.lit("Call chain from "), F.col("node"), F.lit(":\n"), body).alias("chain"))


def dependency_report(deps: DataFrame, dependent: DataFrame, contracts: DataFrame) -> DataFrame:
    """repo, seed, direction, node, label: closures with contract types, or (external) where not indexed; dependents have no label."""
    kinds = contracts.select("repo", F.col("name").alias("node"), "contract_type")
    down = deps.join(kinds, ["repo", "node"], "left").select("repo", "seed", F.lit("depends on").alias("direction"), "node", F.concat(F.lit("("), F.coalesce("contract_type", F.lit("external")), F.lit(")")).alias("label"))
    return down.unionByName(dependent.select("repo", "seed", F.lit("used by").alias("direction"), "node", F.lit("").alias("label")))


def graph_stats(contracts: DataFrame, functions: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """repo, contracts, functions, edges, files_indexed."""
    counted = lambda df, name: df.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    out = counted(sources, "files_indexed")
    for df, name in ((contracts, "contracts"), (functions, "functions"), (edges, "edges")):
        out = out.join(counted(df, name), "repo", "full")
    return out.na.fill(0)


def function_tokens() -> Column:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return 50 + size("calls") * 5 + size("storage_reads") * 3 + size("storage_writes") * 3


def node_tokens(contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """repo, contract, tokens: 100 and the tokens of its functions."""
    summed = functions.groupBy("repo", "contract").agg(F.sum(function_tokens()).alias("t"))
    return contracts.select("repo", F.col("name").alias("contract")).join(summed, ["repo", "contract"], "left").select("repo", "contract", (F.coalesce("t", F.lit(0)) + 100).alias("tokens"))


def build_terms(contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """repo, term, contract: lower-cased names of contracts and functions, distinct."""
    own = contracts.select("repo", F.lower("name").alias("term"), F.col("name").alias("contract"))
    return own.unionByName(functions.select("repo", F.lower("name").alias("term"), "contract")).distinct()


def search(terms: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """repo, query, contract, place: contracts whose term equals, contains or lies within the query; equal ones first, then by name.

    queries: query strings, asked of every repository; few, and compared with distinct terms only. Those within the
    query come by equal join with the query's substrings, not by comparison.
    """
    asked = queries.select("query").distinct().withColumn("q", F.lower("query"))
    names = terms.select("term").distinct()
    # every pair where the term contains the query is joined on the query's first three characters at each place of the term
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    short = asked.filter(F.length("q") < 3)
    containing = names.select("term", F.explode(gram(F.col("term"))).alias("g")).join(asked.filter(F.length("q") >= 3).withColumn("g", F.substring("q", 1, 3)), "g").filter(F.col("term").contains(F.col("q"))).select("query", "term")
    pieces = lambda c, k: F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k))
    every = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("q")), lambda k: pieces(F.col("q"), k))))
    within = asked.filter(F.length("q") > 0).select("query", F.explode(every).alias("term")).join(names, "term").select("query", "term")
    # a query of one or two characters: its terms by their one- and two-character substrings
    small = names.select("term", F.explode(F.array_distinct(F.flatten(F.array(pieces(F.col("term"), F.lit(1)), F.when(F.length("term") > 1, pieces(F.col("term"), F.lit(2))).otherwise(F.array().cast("array<string>")))))).alias("q"))
    brief = small.join(short, "q").select("query", "term")
    hits = containing.unionByName(within).unionByName(brief).distinct()
    ranked = hits.join(terms, "term").groupBy("repo", "query", "contract").agg(F.max((F.col("term") == F.lower("query")).cast("int")).alias("exact"))
    return first_n_per_key(ranked, ["repo", "query"], [F.desc("exact"), "contract"], most).drop("exact")


def contract_lookup(texts: DataFrame, terms: DataFrame, names: DataFrame, most_chars: int = 4000) -> DataFrame:
    """repo, name, answer: the text (repo, name, text) of each asked contract (repo, name), or what else it may be."""
    from ..functions.text import truncate_text

    hit = names.join(texts, ["repo", "name"], "left")
    missed = hit.filter("text is null").select("repo", "name")
    near = search(terms, missed.select(F.col("name").alias("query")), 5).groupBy("repo", F.col("query").alias("name")).agg(F.array_sort(F.collect_list(F.struct("place", "contract"))).alias("near"))
    lead = F.concat(F.lit("Contract '"), F.col("name"), F.lit("' not found"))
    answer = F.when(F.col("near").isNull(), F.concat(lead, F.lit(" in the codebase."))).otherwise(F.concat(lead, F.lit(". Did you mean: "), F.array_join(F.transform("near", lambda x: x["contract"]), ", "), F.lit("?")))
    found = hit.filter("text is not null").select("repo", "name", truncate_text(F.col("text"), most_chars).alias("answer"))
    return found.unionByName(missed.join(near, ["repo", "name"], "left").select("repo", "name", answer.alias("answer")))
