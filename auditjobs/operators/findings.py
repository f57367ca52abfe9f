"""Findings: normalise analyzer reports, triage, merge verdicts, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranked import running

# Check types that are not exploitable in practice.
SKIP_CHECK_TYPES = [
    "solc-version",
    "naming-convention",
    "similar-names",
    "pragma",
    "external-function",
    "low-level-calls",
    "code-complexity",
    "function-state-mutability",
    "cache-array-length",
    "immutable-states",
]
# Check types that need no proof.
AUTO_TRUE_POSITIVE_TYPES = [
    "weak-prng",
    "incorrect-equality",
    "locked-ether",
    "reentrancy-unlimited-gas",
    "reentrancy-eth",
    "arbitrary-send-eth",
    "timestamp",
    "tx-origin",
    "controlled-delegatecall",
    "suicidal",
    "uninitialized-state",
    "uninitialized-storage",
]
# Severities that replace the analyzer's.
SEVERITY_OVERRIDES = {
    "reentrancy-unlimited-gas": "medium",
    "calls-loop": "medium",
    "locked-ether": "medium",
    "timestamp": "low",
    "missing-zero-check": "low",
}
# The order in which severities are shown.
SEVERITY_ORDER = ["critical", "high", "medium", "low", "informational", "optimization"]

_MAPPING = "source_mapping: struct<filename_relative: string, filename_short: string, filename_absolute: string, lines: array<int>>"
_NODE0 = f"struct<type: string, name: string, {_MAPPING}>"
_NODE1 = f"struct<type: string, name: string, {_MAPPING}, type_specific_fields: struct<parent: {_NODE0}>>"
_NODE2 = f"struct<type: string, name: string, {_MAPPING}, type_specific_fields: struct<parent: {_NODE1}>>"
#: One detector, with elements and two levels of parents.
DETECTOR = f"struct<check: string, impact: string, confidence: string, description: string, elements: array<{_NODE2}>>"
#: A report; its detectors stay text until they are one row each.
REPORT = "struct<success: boolean, results: struct<detectors: array<string>>>"


def detectors_of(reports: DataFrame, keys: list[str], report_col: str = "report") -> DataFrame:
    """One row per detector of each successful report: the keys, place, detector (JSON text)."""
    parsed = reports.select(*keys, F.from_json(report_col, REPORT).alias("r")).filter("r.success")
    return parsed.select(*keys, F.posexplode("r.results.detectors").alias("place", "detector"))


def flatten_elements(detectors: DataFrame, detector_col: str = "detector") -> DataFrame:
    """Adds contract, function and location, from a pre-order walk of elements and their parents.

    The walk is an array of nodes, each element followed by its parents; the first named contract and function
    count, and the first node with lines. Three levels; deeper reports take the walk in functions.deep.
    """
    d = F.from_json(detector_col, DETECTOR)

    def flat(x: Column) -> Column:
        p, q = x["type_specific_fields"]["parent"], x["type_specific_fields"]["parent"]["type_specific_fields"]["parent"]
        one = lambda n: F.struct(n["type"].alias("type"), n["name"].alias("name"), n["source_mapping"].alias("at"))
        return F.array(one(x), one(p), one(q))

    nodes = F.flatten(F.transform(F.coalesce(F.col("d.elements"), F.array().cast(f"array<{_NODE2}>")), flat))
    first = lambda kind: F.coalesce(F.get(F.filter("nodes", lambda n: (n["type"] == kind) & (F.coalesce(n["name"], F.lit("")) != "")), F.lit(0))["name"], F.lit(""))
    placed = F.get(F.filter("nodes", lambda n: F.size(F.coalesce(n["at"]["lines"], F.array().cast("array<int>"))) > 0), F.lit(0))["at"]
    some = lambda c: F.when(c != "", c)
    rows = detectors.withColumn("d", d).withColumn("nodes", nodes).withColumn("at", placed)
    file = F.coalesce(some(F.col("at.filename_relative")), some(F.col("at.filename_short")), some(F.col("at.filename_absolute")), F.lit(""))
    location = F.struct(file.alias("file"), F.array_min("at.lines").alias("line_start"), F.array_max("at.lines").alias("line_end"))
    return rows.withColumn("contract", first("contract")).withColumn("function", first("function")).withColumn("location", location).drop("nodes", "at")


def normalize_findings(detectors: DataFrame, id_cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Findings of detector rows: lower-cased severity and confidence, trimmed description, a hash of ``id_cols`` as id."""
    rows = flatten_elements(detectors)
    text = lambda c: F.coalesce(F.col(f"d.{c}"), F.lit(""))
    return rows.select(
        *keys,
        F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in id_cols)), 256).alias("id"),
        F.lit("slither").alias("tool"),
        text("check").alias("check_type"),
        F.lower(text("impact")).alias("severity"),
        F.lower(text("confidence")).alias("confidence"),
        "contract",
        "function",
        "location",
        F.trim(text("description"), F.lit(" \n\t\r")).alias("description"),
        F.lit("").alias("invariant_category"),
        F.lit(False).alias("verified"),
    )


def _check() -> Column:
    return F.trim(F.coalesce(F.col("check_type"), F.lit("")))


def prefilter_findings(findings: DataFrame, skip=SKIP_CHECK_TYPES) -> DataFrame:
    return findings.filter(~_check().isin(list(skip)))


def skipped_findings(findings: DataFrame, skip=SKIP_CHECK_TYPES) -> DataFrame:
    """The rows that the prefilter takes away: all less the kept, by id."""
    return findings.join(prefilter_findings(findings, skip).select("id"), "id", "left_anti")


def apply_severity_overrides(findings: DataFrame, overrides=SEVERITY_OVERRIDES) -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in overrides.items() for x in pair))
    return findings.withColumn("severity", F.coalesce(F.element_at(table, _check()), F.col("severity")))


def flag_auto_true_positive(findings: DataFrame, types=AUTO_TRUE_POSITIVE_TYPES) -> DataFrame:
    return findings.withColumn("is_auto_true_positive", _check().isin(list(types)))


def finding_summary(findings: DataFrame) -> DataFrame:
    rows = flag_auto_true_positive(apply_severity_overrides(findings))
    return rows.select(
        "id", "check_type", "contract", "function", F.coalesce("severity", F.lit("unknown")).alias("severity"),
        F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description"), "is_auto_true_positive",
    )


def finding_detail(findings: DataFrame, ids: DataFrame) -> DataFrame:
    """id, detail: the finding as JSON for each asked id, or what is wrong with the id."""
    text = F.to_json(F.struct(*(F.col(f"f.{c}") for c in findings.columns)), {"ignoreNullFields": "false"})
    unknown = F.concat(F.lit("Error: no finding with id '"), F.col("a.id"), F.lit("'."))
    detail = F.when(F.coalesce(F.col("a.id"), F.lit("")) == "", "Error: finding_id is required.").when(F.col("f.id").isNull(), unknown).otherwise(text)
    return ids.select("id").alias("a").join(findings.alias("f"), F.col("a.id") == F.col("f.id"), "left").select(F.col("a.id").alias("id"), detail.alias("detail"))


def severity_counts(findings: DataFrame, by: list[str] = ()) -> DataFrame:
    """Findings per severity and its place in the order shown; others come last."""
    severity = F.lower(F.coalesce("severity", F.lit("unknown")))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("severity")), F.lit(0))
    counted = findings.withColumn("severity", severity).groupBy(*by, "severity").agg(F.count(F.lit(1)).alias("findings"))
    return counted.withColumn("place", F.when(place == 0, len(SEVERITY_ORDER) + 1).otherwise(place).cast("int"))


def merge_verdicts(findings: DataFrame, submissions: DataFrame) -> DataFrame:
    """finding_id, is_true_positive, reason, exploit_scenario for every finding.

    submissions: batch, finding_id, confirmed, reason, exploit_scenario. Unknown ids do no harm; of several texts the latest batch's wins.
    """
    latest = submissions.groupBy(F.col("finding_id").alias("id")).agg(
        F.bool_or("confirmed").alias("confirmed"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("batch"))).alias("reason"),
        F.max_by("exploit_scenario", F.when(F.col("exploit_scenario").isNotNull(), F.col("batch"))).alias("exploit_scenario"),
    )
    return findings.select("id").join(latest, "id", "left").select(
        F.col("id").alias("finding_id"), F.coalesce("confirmed", F.lit(False)).alias("is_true_positive"),
        F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("exploit_scenario", F.lit("")).alias("exploit_scenario"),
    )


def true_positives(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    return findings.join(verdicts.filter("is_true_positive").select(F.col("finding_id").alias("id")), "id", "left_semi")


def verdict_counts(findings: DataFrame, verdicts: DataFrame, by: list[str] = ()) -> DataFrame:
    known = verdicts.groupBy(F.col("finding_id").alias("id")).agg(F.bool_or("is_true_positive").alias("yes"))
    rows = findings.join(known, "id", "left").groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if("yes").alias("true_positives"))
    return rows.withColumn("false_positives", F.col("total") - F.col("true_positives"))


def report_entries(confirmed: DataFrame, verdicts: DataFrame, replies: DataFrame) -> DataFrame:
    """One entry per confirmed finding: each field of the reply, else the finding's own or the default; severities overridden.

    replies: finding_id, severity, type, difficulty, description, exploit_scenario, recommendations. An empty list, shown as null, counts as missing.
    """
    f = apply_severity_overrides(confirmed).alias("f")
    rows = f.join(verdicts.alias("v"), F.col("v.finding_id") == F.col("f.id"), "left").join(replies.alias("r"), F.col("r.finding_id") == F.col("f.id"), "left")
    pick = lambda reply, *rest: F.coalesce(F.col(f"r.{reply}"), *rest)
    override = F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY_OVERRIDES.items() for x in pair)), F.trim(F.col("f.check_type")))
    return rows.select(
        F.col("f.id").alias("finding_id"),
        F.coalesce(override, F.col("r.severity"), F.col("f.severity"), F.lit("Unknown")).alias("severity"),
        pick("type", F.col("f.check_type"), F.lit("Unknown")).alias("type"),
        pick("difficulty", F.lit("Medium")).alias("difficulty"),
        pick("description", F.col("f.description"), F.lit("")).alias("description"),
        pick("exploit_scenario", F.col("v.exploit_scenario"), F.lit("Exploit verified by agent.")).alias("exploit_scenario"),
        pick("recommendations", F.lit("")).alias("recommendations"),
    )


def assign_batches(candidates: DataFrame, order: list[str], size: int = 10, by: list[str] = ("repo",)) -> DataFrame:
    """batch (from 1) and batches: runs of ``size`` rows in ``order``."""
    rows = running(candidates, list(by), order, batch=F.lit(1))
    count = lambda c: F.ceil(F.col(c) / F.lit(size)).cast("int")
    return rows.withColumn("batches", count("batch_whole")).withColumn("batch", count("batch")).drop("batch_whole")


def number_entries(entries: DataFrame, order: list[str], by: list[str] = ("repo",)) -> DataFrame:
    """number (from 1): the place of each row in ``order``."""
    return running(entries, list(by), order, number=F.lit(1)).withColumn("number", F.col("number").cast("int")).drop("number_whole")


def findings_table(confirmed: DataFrame) -> DataFrame:
    return confirmed.select(
        F.substring(F.upper(F.coalesce("severity", F.lit("unknown"))), 1, 4).alias("severity"), F.coalesce("check_type", F.lit("")).alias("type"),
        F.coalesce("contract", F.lit("")).alias("contract"), F.coalesce("function", F.lit("")).alias("function"),
    )
