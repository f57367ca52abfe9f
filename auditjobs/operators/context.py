"""Per-finding context under a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cap_text, flow_text, list_to_text, truncate_text
from ..sources.scratch import cut, shuffled
from .calls import breaking_changes, call_edges, reentrancy_paths, storage_flows, trace_data_flow
from .extract import extract_decls, extract_state_vars
from .graph import build_edges, call_chain, dependencies, first_n_per_key, graph_stats
from .history import history_text, repo_stats
from .postings import only_candidates
from .ranked import running

# Priority and relevance of each kind of element, in the order in which they are built.
KINDS = {
    "finding": (1, 1.0),
    "source": (1, 0.95),
    "semantic_graph": (1, 0.9),
    "dependency": (2, 0.7),
    "call_graph": (2, 0.8),
    "data_flow": (3, 0.6),
    "git": (4, 0.4),
    "structure": (4, 0.2),
}
TOKENS_PER_CHAR = 0.25
NO_CONTEXT = "No relevant context found."


def finding_text(f: str = "") -> Column:
    """Lines about a finding; file and lines only where known."""
    c = lambda name: F.col(f + name)
    named = lambda label, x, default="Unknown": F.concat(F.lit(label), F.coalesce(x, F.lit(default)))
    file = F.when(F.coalesce(c("location.file"), F.lit("")) != "", c("location.file"))
    lines = F.when(file.isNotNull() & (F.coalesce(c("location.line_start"), F.lit(0)) != 0), F.concat(F.lit("Lines: "), c("location.line_start"), F.lit("-"), F.coalesce(c("location.line_end"), c("location.line_start"))))
    return F.concat_ws(
        "\n", F.concat(F.lit("=== Finding: "), F.coalesce(c("check_type"), F.lit("Unknown")), F.lit(" ===")), named("Severity: ", c("severity")), named("Confidence: ", c("confidence")),
        named("Contract: ", c("contract")), named("Function: ", c("function")), F.concat(F.lit("Description: "), F.substring(F.coalesce(c("description"), F.lit("")), 1, 500)),
        F.concat(F.lit("File: "), file), lines,
    )


def match_paths(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """id, repo, path: the source of each finding's file: the same relative path, else one that ends with it; the first by path.

    Equal paths first; the rest join on the base name, never by comparing all paths.
    """
    wanted = shuffled(findings).select("id", "repo", F.col("location.file").alias("file")).filter("file <> ''").withColumn("base", F.substring_index("file", "/", -1))
    paths = sources.select("repo", "path", F.substring_index("path", "/", -1).alias("base"))
    joined = wanted.join(paths, ["repo", "base"]).filter(F.col("path").endswith(F.col("file")))
    ranked = joined.groupBy("id", "repo").agg(F.min(F.struct((F.col("path") != F.col("file")).alias("other"), F.col("path"))).alias("best"))
    return ranked.select("id", "repo", F.col("best.path").alias("path"))


def source_window(findings: DataFrame, sources: DataFrame, before: int = 20, after: int = 19, most: int = 50_000) -> DataFrame:
    """id, content: the numbered lines around each finding, each marked.

    A file with findings is read and split into lines once, whatever their number, and a line that lies in several windows is
    numbered once; different windows are cut from these lines and then joined to their findings.
    """
    start = F.coalesce("location.line_start", F.lit(1))
    first, last = F.greatest(F.lit(1), start - before), F.coalesce("location.line_end", start) + after
    asked = match_paths(findings, sources).join(shuffled(findings).select("id", "location"), "id").select("id", "repo", "path", "location.file", first.alias("first"), last.alias("last"))
    # a window is a pair of line numbers of its file, so a file's list is bounded by its lines
    per_file = asked.select("repo", "path", "first", "last").distinct().groupBy("repo", "path").agg(F.collect_list(F.struct("first", "last")).alias("windows"), F.min("first").alias("low"), F.max("last").alias("high"))
    number = lambda i: (F.col("low") + i).cast("string")
    padded = lambda n: F.when(F.length(n) < 4, F.lpad(n, 4, " ")).otherwise(n)
    line = lambda x, i: F.concat(F.lit(">>> "), padded(number(i)), F.lit(" | "), x)
    between = lambda a, b: F.slice(a, b[0], F.greatest(b[1] - b[0] + 1, F.lit(0)))
    files = sources.join(per_file, ["repo", "path"]).select("repo", "path", "windows", "low", F.transform(between(F.split("content", "\n"), (F.col("low"), F.col("high"))), line).alias("shown"))
    cut_out = files.select("repo", "path", "low", "shown", F.inline("windows"))
    texts = cut_out.select("repo", "path", "first", "last", F.array_join(between("shown", (F.col("first") - F.col("low") + 1, F.col("last") - F.col("low") + 1)), "\n").alias("text"))
    content = F.concat(F.lit("=== Source: "), F.col("file"), F.lit(" ===\n"), F.col("text"))
    return asked.join(texts, ["repo", "path", "first", "last"]).select("id", cap_text(content, most).alias("content"))


def _line(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, ", ")))


def contract_text(contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """repo, name, head, function_lines array<struct<name, text, rest>>, tail: the parts of a contract's description, made once a contract."""
    call, write = F.slice("calls", 1, 5), F.slice("storage_writes", 1, 5)
    head = F.concat(F.lit("  - "), "visibility", F.lit(" "), "mutability", F.lit(" "), "name", F.lit("("), F.array_join("parameters", ", "), F.lit(")"))
    rest = F.concat_ws("\n", _line("    Calls: ", call), _line("    Writes: ", write))
    own = functions.groupBy("repo", "contract").agg(F.array_sort(F.collect_list(F.struct("line_start", "name", head.alias("text"), rest.alias("rest")))).alias("functions"))
    named = lambda df, c: df.groupBy("repo", "contract").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias(c))
    variables = extract_state_vars(contracts).groupBy("repo", "contract").agg(F.array_sort(F.collect_list(F.concat(F.lit("  - "), "var_type", F.lit(" "), "var"))).alias("variables"))
    rows = contracts.select("repo", F.col("name").alias("contract"), "contract_type", "path", "line_start", "line_end", "inherits")
    for df in (own, variables, named(extract_decls(contracts, "event"), "events"), named(extract_decls(contracts, "error"), "errors")):
        rows = rows.join(df, ["repo", "contract"], "left")
    names = lambda c: F.transform(c, lambda x: x["name"])
    top = F.concat_ws(
        "\n", F.concat(F.lit("=== "), "contract", F.lit(" ("), "contract_type", F.lit(") in "), "path", F.lit(" ===")), F.concat(F.lit("Lines: "), "line_start", F.lit("-"), "line_end"),
        _line("Inherits: ", F.col("inherits")), F.when(F.size("variables") > 0, F.concat(F.lit("State Variables:\n"), list_to_text(F.col("variables")))), F.when(F.size("functions") > 0, F.lit("Functions:")),
    )
    bottom = F.concat_ws("\n", _line("Events: ", names("events")), _line("Errors: ", names("errors")))
    return rows.select("repo", F.col("contract").alias("name"), top.alias("head"), "functions", bottom.alias("tail"))


def with_focus(focus: Column | None = None) -> Column:
    """The whole text from the parts of :func:`contract_text`, with the focus function marked."""

    def shown(x):
        text = x["text"] if focus is None else F.concat(x["text"], F.when(x["name"] == focus, " [FOCUS]").otherwise(""))
        return F.concat(text, F.when(x["rest"] != "", F.concat(F.lit("\n"), x["rest"])).otherwise(""))

    body = F.array_join(F.transform("functions", shown), "\n")
    return F.concat_ws("\n", "head", body, F.when(F.col("tail") != "", F.col("tail")))


def finding_contracts(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """id, content: the finding's contract, its function marked."""
    joined = shuffled(findings).select("id", "repo", F.col("contract").alias("name"), F.col("function").alias("focus")).join(texts, ["repo", "name"])
    return joined.select("id", with_focus(F.col("focus")).alias("content"))


def _dependency_names(findings: DataFrame, edges: DataFrame, texts: DataFrame, max_depth: int) -> DataFrame:
    """repo, contract, name: the dependencies of each indexed contract that has findings. Closures run once a contract."""
    owners = findings.select("repo", F.col("contract").alias("name")).filter("name <> ''").distinct()
    known = owners.join(texts.select("repo", "name"), ["repo", "name"], "left_semi").select("repo", F.col("name").alias("seed"))
    return dependencies(edges, known, max_depth).select("repo", F.col("seed").alias("contract"), F.col("node").alias("name"))


def finding_dependencies(findings: DataFrame, edges: DataFrame, texts: DataFrame, max_depth: int = 5) -> DataFrame:
    """id, place, content: each indexed dependency of the finding's contract, by name."""
    deps = _dependency_names(findings, edges, texts, max_depth)
    rows = deps.join(texts, ["repo", "name"]).select("repo", "contract", "name", with_focus().alias("content"))
    place = F.row_number().over(Window.partitionBy("repo", "contract").orderBy("name"))
    return shuffled(findings).select("id", "repo", "contract").join(rows.withColumn("place", place), ["repo", "contract"]).select("id", "place", "content")


def finding_call_context(findings: DataFrame, call_edges: DataFrame, functions: DataFrame, max_depth: int = 5) -> DataFrame:
    """id, content: call chain, first three reentrancy paths of the contract, first five callers of the function.

    Texts are made once a function, and the long ones stay where call_chain dealt them: only keys and ids move to them.
    """
    asked = findings.filter("contract <> '' and function <> ''").select("id", "repo", "contract", "function", F.concat_ws(".", "contract", "function").alias("seed"))
    named = cut(asked.select("repo", "contract", "function", "seed").distinct())
    chains = call_chain(call_edges, named.select("repo", "seed"), max_depth)
    paths = first_n_per_key(reentrancy_paths(functions, call_edges).withColumn("text", F.concat(F.lit("  "), flow_text(F.col("path")))), ["repo", "contract"], ["function"], 3)
    paths = paths.groupBy("repo", "contract").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("paths"))
    callers = breaking_changes(shuffled(call_edges), named)
    text = F.concat(F.lit("  "), F.concat_ws(".", "affected_contract", "affected_function"), F.when(F.col("is_external"), " (external)").otherwise(" (internal)"))
    callers = first_n_per_key(callers.withColumn("text", text), ["repo", "contract", "function"], ["affected_contract", "affected_function", "is_external"], 5)
    callers = callers.groupBy("repo", "contract", "function").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("callers"))
    lines = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n")
    after = F.concat_ws("\n", F.concat(F.lit("\nPotential reentrancy paths:\n"), lines("paths")), F.concat(F.lit("\nBreaking change impact:\n"), lines("callers")))
    told = shuffled(named).join(paths, ["repo", "contract"], "left").join(callers, ["repo", "contract", "function"], "left").select("repo", "seed", "contract", "function", after.alias("after"))
    # names with dots may give several functions one seed
    told = told.groupBy("repo", "seed").agg(F.collect_list(F.struct("contract", "function", "after")).alias("told"))
    rows = shuffled(asked).join(shuffled(told).join(chains, ["repo", "seed"]), ["repo", "seed"])
    own = F.element_at(F.filter("told", lambda x: (x["contract"] == F.col("contract")) & (x["function"] == F.col("function"))), 1)["after"]
    return rows.select("id", F.concat_ws("\n", F.lit("=== Call Graph Context ==="), "chain", F.when(own != "", own)).alias("content"))


def finding_flow_context(findings: DataFrame, functions: DataFrame, flows: DataFrame) -> DataFrame:
    """id, content: first ten reads and writes of the finding's function, and for its first three written variables the first three flows."""
    own = shuffled(findings).select("id", "repo", "contract", F.col("function").alias("name")).join(functions.select("repo", "contract", "name", "storage_reads", "storage_writes"), ["repo", "contract", "name"])
    written = own.select("id", "repo", "contract", F.posexplode(F.slice("storage_writes", 1, 3)).alias("at", "var"))
    traced = trace_data_flow(shuffled(flows), written).select("repo", "contract", "var", F.concat(F.lit("  "), flow_text(F.col("path")), F.lit(" ("), "flow_type", F.lit(")")).alias("text"))
    few = first_n_per_key(traced, ["repo", "contract", "var"], ["text"], 3).groupBy("repo", "contract", "var").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("xs"))
    block = F.concat(F.lit("\nData flow for "), "var", F.lit(":\n"), F.array_join(F.transform("xs", lambda x: x["text"]), "\n"))
    blocks = written.join(few, ["repo", "contract", "var"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", block.alias("text")))).alias("blocks"))
    content = F.concat_ws(
        "\n", F.lit("=== Data Flow Context ==="), _line("Reads: ", F.slice("storage_reads", 1, 10)), _line("Writes: ", F.slice("storage_writes", 1, 10)),
        F.array_join(F.transform("blocks", lambda x: x["text"]), "\n"),
    )
    return own.join(blocks, "id", "left").select("id", content.alias("content"))


def structure_text(findings: DataFrame, stats: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """id, content: counts of the finding's repository, from graph_stats and, where it has commits, repo_stats. A row of each is one repository."""
    if history is not None:
        stats = stats.join(history.select("repo", "total_commits", "contributors"), "repo", "left")
    shown = {"Contracts: ": "contracts", "Functions: ": "functions", "Dependencies: ": "edges", "Commits: ": "total_commits", "Contributors: ": "contributors"}
    lines = [F.concat(F.lit(label), F.col(c)) for label, c in shown.items() if c in stats.columns]  # null where there is no history, and then no line
    per_repo = stats.select("repo", F.concat_ws("\n", F.lit("=== Project Structure ==="), *lines).alias("content"))
    return findings.select("id", "repo").join(per_repo, "repo").select("id", "content")


def context_elements(parts: dict[str, DataFrame], switched_off: tuple[str, ...] = ()) -> DataFrame:
    """id, seq, content, priority, source, tokens, relevance: the union of (id, content[, place]) per kind, in the kinds' order."""
    found = []
    for n, (kind, (priority, relevance)) in enumerate(KINDS.items()):
        if kind in parts and kind not in switched_off:
            df = parts[kind]
            place = F.col("place") if "place" in df.columns else F.lit(0)
            found.append(df.select("id", (F.lit(n * 100_000) + place).cast("int").alias("seq"), "content", F.lit(priority).alias("priority"), F.lit(kind).alias("source"), F.floor(F.length("content") * TOKENS_PER_CHAR).cast("int").alias("tokens"), F.lit(relevance).alias("relevance")))
    return reduce(DataFrame.unionByName, found)


def all_elements(findings: DataFrame, sources: DataFrame, contracts: DataFrame, functions: DataFrame, commits: DataFrame, numstat: DataFrame, as_of: Column, switched_off: tuple[str, ...] = (), texts: DataFrame | None = None) -> DataFrame:
    """The elements of all eight kinds from findings, an index (contracts, functions) and a history, less those switched off.

    What several kinds read (edges, texts, call edges) is made once and written; pass an index that is written too.
    texts: what contract_text makes of them, if that is written already. Joins of these tables shuffle: files of such texts are many times smaller than they.
    """
    contracts, functions, sources = shuffled(contracts), shuffled(functions), shuffled(sources)
    edges = shuffled(cut(build_edges(contracts, functions)))
    texts = shuffled(cut(contract_text(contracts, functions)) if texts is None else texts)
    calls = shuffled(cut(call_edges(functions, extract_state_vars(contracts), contracts)))
    parts = {
        "finding": lambda: findings.select("id", finding_text().alias("content")),
        "source": lambda: source_window(findings, sources),
        "semantic_graph": lambda: finding_contracts(findings, texts),
        "dependency": lambda: finding_dependencies(findings, edges, texts),
        "call_graph": lambda: finding_call_context(findings, calls, functions),
        "data_flow": lambda: finding_flow_context(findings, functions, storage_flows(functions, edges)),
        "git": lambda: history_text(findings, commits, numstat, as_of),
        "structure": lambda: structure_text(findings, graph_stats(contracts, functions, edges, sources), repo_stats(commits, as_of)),
    }
    return context_elements({kind: make() for kind, make in parts.items() if kind not in switched_off})


def pack_context(elements: DataFrame, max_tokens: int = 30_000, buffer: int = 0, suffix: str = "\n... (context truncated)") -> DataFrame:
    """id, context, used: elements by priority, relevance and seq up to the first that overflows; that one is cut if over 200
    tokens remain. 0 tokens: all. Texts are dealt by finding once and written nowhere; those beyond the budget go before lists are made."""
    budget = max_tokens - buffer
    w = Window.partitionBy("id").orderBy("priority", F.desc("relevance"), "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = elements.select("id", "priority", "relevance", "seq", "tokens", "content").withColumn("run", F.sum("tokens").over(w)).withColumn("place", F.count(F.lit(1)).over(w))
    room = budget - F.col("run") + F.col("tokens")
    whole = F.lit(max_tokens == 0) | (F.col("run") <= budget)
    # tokens are never negative, so of the rows beyond the budget the first is the one that still began within it
    text = F.when(whole, F.col("content")).when(room > 200, F.concat(F.substring("content", F.lit(1), F.floor(room / F.lit(TOKENS_PER_CHAR)).cast("int")), F.lit(suffix)))
    kept = rows.select("id", "place", text.alias("text"), F.when(whole, F.col("tokens")).otherwise(0).alias("used")).filter((F.col("place") == 1) | F.col("text").isNotNull())
    texts = F.collect_list(F.when(F.col("text").isNotNull(), F.struct("place", "text")))
    packed = kept.groupBy("id").agg(F.array_sort(texts).alias("xs"), F.sum("used").alias("used"))
    return packed.select("id", F.array_join(F.transform("xs", lambda x: x["text"]), "\n\n").alias("context"), F.col("used").cast("long").alias("used"))


def pack_contracts(findings: DataFrame, texts: DataFrame, edges: DataFrame, max_tokens: int = 15_000) -> DataFrame:
    """id, context: the finding's contract and its dependencies within two hops by name, whole, up to the first that overflows; else a message.

    Running sizes decide once a contract which dependencies can fit; only their texts are gathered, at most the budget a contract.
    """
    size = lambda x: F.floor(F.length(x) / F.lit(4))
    w = Window.partitionBy("repo", "contract").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    sized = _dependency_names(findings, edges, texts, 2).join(texts.select("repo", "name", size(with_focus()).alias("tokens")), ["repo", "name"])
    fit = sized.withColumn("run", F.sum("tokens").over(w)).filter(F.col("run") <= max_tokens).select("repo", "contract", "name", "run")
    parts = fit.join(texts, ["repo", "name"]).groupBy("repo", "contract").agg(F.array_sort(F.collect_list(F.struct("name", "run", with_focus().alias("content")))).alias("parts"))
    named = findings.select("id", "repo", "contract", "function").join(texts.withColumnRenamed("name", "contract"), ["repo", "contract"])
    own = named.select("id", "repo", "contract", with_focus(F.col("function")).alias("content")).withColumn("tokens", size(F.col("content"))).filter(F.col("tokens") <= max_tokens)
    added = F.transform(F.filter("parts", lambda x: x["run"] + F.col("tokens") <= max_tokens), lambda x: x["content"])
    packed = own.join(parts, ["repo", "contract"], "left").select("id", F.concat_ws("\n\n", "content", added).alias("context"))
    return findings.select("id").join(packed, "id", "left").select("id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def project_overview(contracts: DataFrame, functions: DataFrame) -> DataFrame:
    """repo, name, contract_type, functions, project_contracts, project_functions."""
    counted = functions.groupBy("repo", F.col("contract").alias("name")).agg(F.count(F.lit(1)).alias("functions"))
    rows = contracts.select("repo", "name", "contract_type").join(counted, ["repo", "name"], "left").na.fill(0, ["functions"])
    totals = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("project_contracts"), F.sum("functions").alias("project_functions"))
    return rows.join(totals, "repo")


def grep(sources: DataFrame, pattern: str, glob: str | None = None, most_chars: int = 4000, postings: DataFrame | None = None) -> DataFrame:
    """repo, result: matching lines as path:number:text by path and number, '(no matches)' where a repository has none, cut at ``most_chars``.

    Whole files are tested before lines are made. glob: * and ? within a path's last part. With the trigram postings of the
    sources only files that have the pattern's texts are read; the pattern itself decides, so results are the same.
    """
    rows = sources if postings is None else only_candidates(sources, postings, pattern)
    if glob is not None:
        part = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\Q" + c + "\\E" for c in glob)
        rows = rows.filter(F.substring_index("path", "/", -1).rlike(f"^{part}$"))
    hit = rows.filter(F.col("content").rlike("(?m)" + pattern)).select("repo", "path", F.posexplode(F.split("content", "\n")).alias("number", "text")).filter(F.col("text").rlike(pattern))
    line = F.concat("path", F.lit(":"), F.col("number") + 1, F.lit(":"), "text")
    # running lengths stop the collection early: only lines that begin within the cap are gathered
    near = running(hit.select("repo", "path", "number", line.alias("line")), ["repo"], ["path", "number"], run=F.length("line") + 1).filter(F.col("run") - F.length("line") - 1 <= most_chars)
    text = near.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "number", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return sources.select("repo").distinct().join(text, "repo", "left").select("repo", truncate_text(F.coalesce("text", F.lit("(no matches)")), most_chars).alias("result"))
