"""Jobs over files: source trees, analyzer reports, commit logs and replies in; tables by repository, contexts and a report out."""

from __future__ import annotations

import zlib
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import calls, context, extract, findings, graph, history, postings, replies
from ..sources import files

#: Findings of one contract beyond which tables are not laid out by contract, since a bucket is one task's.
HOT_FINDINGS = 100_000


class Store:
    """Tables below a folder. Those of inputs have a partition a repository, which is replaced as a whole, also by no rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, name: str, rows: DataFrame, repo: str | None = None) -> DataFrame:
        """Write one repository's rows, or without a repository the whole table; returns what was written."""
        at = f"{self.root}/{name}" + ("" if repo is None else f"/repo={quote(repo, safe='')}")
        kept = rows if repo is None else rows.drop("repo")
        kept.write.mode("overwrite").option("compression", "zstd").parquet(at)
        held = self.spark.read.schema(kept.schema).parquet(at)
        return held if repo is None else held.select(F.lit(repo).alias("repo"), *held.columns)

    def put_buckets(self, name: str, rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
        """Write a whole table in sorted buckets. Tables of as many buckets by keys of one meaning join on them without an exchange."""
        table = f"store_{zlib.crc32(self.root.encode()):08x}_{name}"
        laid = rows.repartition(buckets, *by).write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, *by).sortBy(*by)
        laid.option("path", f"{self.root}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def get(self, name: str) -> DataFrame:
        """The table with all repositories; their names stay text, whatever they look like."""
        at = f"{self.root}/{name}"
        schema = self.spark.read.parquet(at).schema
        return self.spark.read.schema(StructType([StructField("repo", StringType()) if f.name == "repo" else f for f in schema])).parquet(at)


def index_sources(spark: SparkSession, root: str, repo: str, store: Store) -> None:
    """sources, contracts, functions, state_vars, edges, terms, trigrams, call_edges and flows of a source tree."""
    sources = store.put("sources", files.read_sources(spark, root, repo), repo)
    contracts = store.put("contracts", extract.latest_contracts(extract.extract_contracts(sources)), repo)
    functions = store.put("functions", extract.extract_storage_access(extract.extract_calls(extract.extract_functions(contracts))), repo)
    variables = store.put("state_vars", extract.extract_state_vars(contracts), repo)
    edges = store.put("edges", graph.build_edges(contracts, functions), repo)
    store.put("terms", graph.build_terms(contracts, functions), repo)
    store.put("trigrams", postings.trigram_postings(sources).repartitionByRange("trigram", "path").sortWithinPartitions("trigram"), repo)
    store.put("call_edges", calls.call_edges(functions, variables, contracts), repo)
    store.put("flows", calls.storage_flows(functions, edges), repo)


def index_history(spark: SparkSession, log: str, repo: str, store: Store) -> None:
    """commits and numstat of a commit log."""
    parsed = history.parse_commit_log(files.read_commit_log(spark, log, repo))
    store.put("commits", parsed.drop("stats"), repo)
    store.put("numstat", history.parse_numstat(parsed.select("repo", "hash", F.explode("stats").alias("line")), "line", "repo", "hash"), repo)


def index_blame(spark: SparkSession, blame: str, repo: str, store: Store) -> None:
    store.put("blame", files.read_blame(spark, blame, repo), repo)


def read_findings(spark: SparkSession, reports: str, repo: str, store: Store) -> None:
    """findings of analyzer reports; equal detectors of a repository are one finding."""
    detectors = findings.detectors_of(files.read_reports(spark, reports, repo), ["repo"])
    store.put("findings", findings.normalize_findings(detectors, ["repo", "detector"], ["repo"]).dropDuplicates(["id"]), repo)


def by_contract(store: Store, wanted: DataFrame, contracts: DataFrame, functions: DataFrame, buckets: int, hot: int = HOT_FINDINGS) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(findings, functions, contract texts), laid out in matching buckets by repository and contract where no contract has over ``hot`` findings.

    Otherwise findings and functions as given and None: their joins then shuffle, and adaptive execution splits the hot contract.
    Joins on these keys and more (a function's name) go without an exchange where spark.sql.requireAllClusterKeysForCoPartition is false.
    """
    most = wanted.groupBy("repo", "contract").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > hot:
        return wanted, functions, None
    put = lambda name, rows, key: store.put_buckets(f"{name}_by_contract", rows, ["repo", key], buckets)
    functions = put("functions", functions, "contract")
    return put("findings", wanted, "contract"), functions, put("texts", context.contract_text(contracts, functions), "name")


def assemble_contexts(store: Store, as_of: Column, max_tokens: int = 30_000, batch_size: int = 10, buckets: int = 200) -> DataFrame:
    """contexts: repo, id, batch, batches, context, used of every finding worth acting on, of all repositories in the store.

    buckets: of the tables that contexts join by contract; some 100 MB of contract texts a bucket suit a task.
    """
    contracts = store.get("contracts")
    wanted, functions, texts = by_contract(store, findings.prefilter_findings(store.get("findings")), contracts, store.get("functions"), buckets)
    elements = context.all_elements(wanted, store.get("sources"), contracts, functions, store.get("commits"), store.get("numstat"), as_of, texts=texts)
    packed = context.pack_context(elements, max_tokens)
    batches = findings.assign_batches(wanted, ["id"], batch_size).select("repo", "id", "batch", "batches")
    return store.put("contexts", batches.join(packed, "id"))


def search_text(store: Store, pattern: str, glob: str | None = None) -> DataFrame:
    """repo, result: lines of the stored sources that match, found through their trigrams."""
    return context.grep(store.get("sources"), pattern, glob, postings=store.get("trigrams"))


def read_verdicts(spark: SparkSession, submissions: str, store: Store) -> DataFrame:
    """verdicts: repo, finding_id, is_true_positive, reason, exploit_scenario, from submissions as files of one text each, named by batch number."""
    text = spark.read.text(submissions, wholetext=True)
    batch = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).try_cast("int")
    parsed = replies.parse_submissions(text.select(batch.alias("batch"), F.col("value").alias("raw")), ["batch"])
    known = store.get("findings")
    merged = findings.merge_verdicts(known, parsed)
    return store.put("verdicts", known.select("repo", F.col("id").alias("finding_id")).join(merged, "finding_id"))


def report(store: Store, path: str, written: DataFrame | None = None) -> None:
    """The report of all confirmed findings, a folder a repository. written: replies with the entries' texts, else findings speak for themselves."""
    fields = "finding_id string, severity string, type string, difficulty string, description string, exploit_scenario string, recommendations string"
    written = store.spark.createDataFrame([], fields) if written is None else written
    verdicts = store.get("verdicts")
    confirmed = findings.true_positives(store.get("findings"), verdicts)
    entries = findings.report_entries(confirmed, verdicts, written).join(confirmed.select(F.col("id").alias("finding_id"), "repo"), "finding_id")
    files.write_report(findings.number_entries(entries, ["finding_id"]), path)
