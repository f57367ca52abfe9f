"""Facts of source files: contracts, functions, variables, declarations, calls, storage access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import parse_contract_spans, parse_function_spans

# Patterns and the words they leave out. (?U): Unicode word characters; (?d): only \n ends lines.
STATE_VARIABLE = r"(?Udm)^\s*(mapping\s*\([^)]+\)|\w+(?:\[\])?)\s+(public|private|internal|constant|immutable)?\s*(\w+)\s*[;=]"
DECLARATION = r"(?Udm)^\s*%s\s+(\w+)\s*\("
USING = r"(?Udm)^\s*using\s+(\w+)\s+for"
METHOD_CALL = r"(?U)(\w+)\s*\.\s*(\w+)\s*\("
METHOD_CALL_WITH_OPTIONS = r"(?U)(\w+)\s*\.\s*(\w+)\s*(?:\{[^}]*\}\s*)?\("
DIRECT_CALL = r"(?U)(?<!\.)\b(\w+)\s*\([^)]*\)"
WRITE = r"(?U)(\w+)\s*(?:=|\+=|-=|\*=|/=|%=|<<=|>>=|&=|\|=|\^=)\s*[^=]"
READ = r"(?U)\b([a-z]\w*)\b"
PRAGMA = r"(?U)pragma\s+solidity\s+([^;]+);"
VERSION = r"(?U)(\d+\.\d+\.\d+)"
NO_OBJECTS = ["require", "assert", "revert", "emit", "new", "this"]
NO_CALLS = [
    "require", "assert", "revert", "emit", "new", "return",
    "if", "while", "for", "mapping", "address", "bytes", "string",
    "uint", "int", "bool", "keccak256", "abi", "msg", "block", "tx",
]
NO_WRITES = ["msg", "block", "tx", "this", "super"]
NO_READS = [
    "require", "assert", "revert", "emit", "return", "if", "else", "while",
    "for", "mapping", "address", "bytes", "string", "uint", "int", "bool",
    "msg", "block", "tx", "this", "super", "true", "false", "new", "delete",
    "storage", "memory", "calldata", "payable", "view", "pure", "external",
    "public", "internal", "private", "virtual", "override",
]


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _words(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def latest_definition(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c for c in order))
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def extract_contracts(sources: DataFrame) -> DataFrame:
    """repo, name, path, contract_type, inherits, line_start, line_end, body of every contract in every file. Narrow."""
    return sources.select("repo", "path", F.inline(parse_contract_spans("content"))).select("repo", "name", "path", "contract_type", "inherits", "line_start", "line_end", "body")


def latest_contracts(contracts: DataFrame) -> DataFrame:
    return latest_definition(contracts, ["repo", "name"], ["path", "line_start"])


def extract_functions(contracts: DataFrame) -> DataFrame:
    """Functions with absolute lines; of equal names in a contract the last counts (within a row, so no shuffle)."""
    spans = parse_function_spans("body")
    rows = contracts.select("repo", F.col("name").alias("contract"), "path", F.col("line_start").alias("base"), spans.alias("spans"))
    # a later span of the same name drops the earlier ones
    last = F.filter("spans", lambda x, i: ~F.exists(F.slice("spans", i + 2, F.size("spans")), lambda y: y["name"] == x["name"]))
    rows = rows.select("repo", "contract", "path", "base", F.inline(last))
    return rows.select(
        "repo", "contract", "name", "path",
        (F.col("base") + F.col("first")).alias("line_start"), (F.col("base") + F.col("first") + F.col("lines") - 1).alias("line_end"),
        "visibility", "mutability", "modifiers", "parameters", "return_types",
        (F.col("name") == "constructor").alias("is_constructor"), (F.col("name") == "fallback").alias("is_fallback"), (F.col("name") == "receive").alias("is_receive"),
        "body",
    )


def extract_state_vars(contracts: DataFrame) -> DataFrame:
    """repo, contract, var, var_type; of equal names in a contract the last counts."""
    pairs = F.arrays_zip(_all(F.col("body"), STATE_VARIABLE, 3).alias("var"), _all(F.col("body"), STATE_VARIABLE, 1).alias("var_type"))
    rows = contracts.select("repo", F.col("name").alias("contract"), pairs.alias("pairs"))
    last = F.filter("pairs", lambda x, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda y: y["var"] == x["var"]))
    return rows.select("repo", "contract", F.inline(last))


def extract_decls(contracts: DataFrame, kind: str) -> DataFrame:
    """repo, contract, place, name of the ``event``, ``error`` or ``modifier`` declarations."""
    return contracts.select("repo", F.col("name").alias("contract"), F.posexplode(_all(F.col("body"), DECLARATION % kind)).alias("place", "name"))


def extract_uses(contracts: DataFrame) -> DataFrame:
    return contracts.select("repo", F.col("name").alias("contract"), F.posexplode(_all(F.col("body"), USING)).alias("place", "name"))


def calls_of(body: Column, call_options: bool = False) -> Column:
    """Sorted distinct calls: object.method for most objects, and names called directly."""
    pattern = METHOD_CALL_WITH_OPTIONS if call_options else METHOD_CALL
    methods = F.filter(F.arrays_zip(_all(body, pattern, 1).alias("o"), _all(body, pattern, 2).alias("m")), lambda x: ~x["o"].isin(NO_OBJECTS))
    direct = F.array_except(_all(body, DIRECT_CALL), _words(NO_CALLS))
    return F.array_sort(F.array_union(F.transform(methods, lambda x: F.concat_ws(".", x["o"], x["m"])), direct))


def writes_of(body: Column) -> Column:
    return F.array_sort(F.array_except(_all(body, WRITE), _words(NO_WRITES)))


def reads_of(body: Column) -> Column:
    return F.array_sort(F.array_except(F.array_except(_all(body, READ), _words(NO_READS)), writes_of(body)))


def extract_calls(functions: DataFrame, call_options: bool = False) -> DataFrame:
    return functions.withColumn("calls", calls_of(F.col("body"), call_options))


def extract_storage_access(functions: DataFrame) -> DataFrame:
    return functions.withColumn("storage_writes", writes_of(F.col("body"))).withColumn("storage_reads", reads_of(F.col("body")))


def extract_pragma(sources: DataFrame) -> DataFrame:
    """repo, path, pragma, version; null where there is none."""
    pragma = F.trim(F.regexp_extract("content", PRAGMA, 1))
    rows = sources.select("repo", "path", F.when(pragma != "", pragma).alias("pragma"))
    version = F.regexp_extract("pragma", VERSION, 1)
    return rows.withColumn("version", F.when(version != "", version))


def index(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contracts, functions) of the latest definitions, with variables left to :func:`extract_state_vars`."""
    contracts = latest_contracts(extract_contracts(sources))
    return contracts, extract_storage_access(extract_calls(extract_functions(contracts)))
