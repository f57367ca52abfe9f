"""One registered query per operator, with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import calls as C
from ..operators import context as X
from ..operators import extract as E
from ..operators import findings as N
from ..operators import graph as G
from ..operators import history as H
from ..operators import postings as P
from ..operators import replies as R
from ..sources import files as S
from ..sources.scratch import cut, shared_folder, shuffled
from . import adapters as A

QUERIES, ORACLE_SQL = {}, {}
#: The moment that ages count from.
AS_OF_SQL = f"TIMESTAMP '{A.AS_OF}'"

#: Facts of the generated sources by arithmetic, never read from text.
_SHARED = {name: sql.format(**{t: t for t in A.TABLES}) for name, sql in A.SQL.items()} | {
    "findings": A.FINDINGS_SQL,
    "sup": "SELECT s_suppkey AS k, s_nationkey AS nk, (SELECT count(*) FROM supplier) AS n FROM supplier",
    "fs": "SELECT *, CASE WHEN j = 9 THEN 'setV' ELSE 'f' || j END AS name FROM (SELECT k, nk, n, unnest(range(10)) AS j FROM sup)",
    "contracts": """
        SELECT 'S' || k AS name, 'contract' AS contract_type, ['N' || nk] AS inherits, 'src/S' || k || '.sol' AS path, 2 AS line_start, 79 AS line_end FROM sup
        UNION ALL SELECT 'N' || n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'abstract' WHEN 1 THEN 'interface' WHEN 2 THEN 'library' ELSE 'contract' END, [],
               'src/N' || n_nationkey || '.sol', 1, 5 FROM nation""",
    "functions": """
        SELECT 'S' || k AS contract, name, CAST(19 + 6 * j AS INT) AS line_start, CAST(24 + 6 * j AS INT) AS line_end,
               CASE (k + j) % 5 WHEN 0 THEN 'external' WHEN 1 THEN 'public' WHEN 2 THEN 'internal' WHEN 3 THEN 'private' ELSE 'public' END AS visibility,
               CASE (k + j) % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'pure' WHEN 2 THEN 'payable' ELSE 'nonpayable' END AS mutability,
               CASE WHEN j % 3 = 0 THEN ['onlyOwner'] ELSE [] END AS modifiers, ['S' || ((3 * k + j) % n) || ' p' || j, 'uint256 x'] AS parameters,
               CASE WHEN j % 2 = 0 THEN ['uint256'] ELSE [] END AS return_types,
               list_sort(list_distinct(CASE WHEN j % 2 = 0 THEN ['returns'] ELSE [] END || [name, 'f' || ((j + 2) % 9), 't' || (j % 3) || '.f' || j, 'p' || j || '.f' || ((j + 1) % 9)])) AS calls,
               ['v' || j] AS storage_writes,
               list_sort(list_distinct(['function', name, 'p' || j, 'uint256', 'x', 'v' || ((j + 1) % 10), 'f' || ((j + 2) % 9), 't' || (j % 3), 'f' || j, 'f' || ((j + 1) % 9)]
                   || CASE WHEN j % 3 = 0 THEN ['onlyOwner'] ELSE [] END || CASE WHEN j % 2 = 0 THEN ['returns'] ELSE [] END)) AS storage_reads
        FROM fs
        UNION ALL SELECT 'N' || n_nationkey, 'g' || n_nationkey, 2, 4, 'public', 'nonpayable', [], ['uint256 y'], [], ['g' || n_nationkey], ['w'],
               list_sort(['function', 'g' || n_nationkey, 'uint256', 'y']) FROM nation""",
    "vars": """
        SELECT 'S' || k AS contract, 't0' AS var, 'S' || ((7 * k) % n) AS var_type FROM sup
        UNION ALL SELECT 'S' || k, 't1', 'mapping(address => S' || ((7 * k + 1) % n) || ')' FROM sup
        UNION ALL SELECT 'S' || k, 'v' || unnest(range(10)), 'uint256' FROM sup""",
    "graph": """
        SELECT 'S' || k AS source, 'N' || nk AS target, 'inherits' AS edge_type, 3 AS weight, NULL AS function, NULL AS method FROM sup
        UNION ALL SELECT 'S' || k, 'L' || (k % 3), 'uses', 2, NULL, NULL FROM sup
        UNION ALL SELECT 'S' || k, 't' || (j % 3), 'calls', 1, name, 'f' || j FROM fs
        UNION ALL SELECT 'S' || k, 'p' || j, 'calls', 1, name, 'f' || ((j + 1) % 9) FROM fs""",
    "cedges": """
        SELECT contract AS src_contract, name AS src_function, contract AS dst_contract, c AS dst_function, false AS is_external
        FROM (SELECT contract, name, unnest(calls) AS c FROM functions) x WHERE EXISTS (SELECT 1 FROM functions f WHERE f.contract = x.contract AND f.name = x.c)
        UNION ALL SELECT 'S' || k, fs.name, coalesce((SELECT c.name FROM contracts c WHERE c.name = v.var_type), (SELECT min(c.name) FROM contracts c WHERE contains(v.var_type, c.name)), 't' || (j % 3)), 'f' || j, true
        FROM fs LEFT JOIN vars v ON v.contract = 'S' || k AND v.var = 't' || (j % 3)
        UNION ALL SELECT 'S' || k, fs.name, coalesce((SELECT c.name FROM contracts c WHERE c.name = 'S' || ((3 * k + j) % n)), 'p' || j), 'f' || ((j + 1) % 9), true FROM fs""",
    "flows": """
        SELECT w.contract AS c1, w.name AS f1, r.contract AS c2, r.name AS f2, w.v AS var,
               regexp_matches(lower(w.name), 'deposit|withdraw|transfer|approve|mint|burn|set|update|change|add|remove|initialize') AS tainted
        FROM (SELECT contract, name, unnest(storage_writes) AS v FROM functions) w
        JOIN (SELECT DISTINCT name AS owner, name AS reader FROM contracts
              UNION SELECT DISTINCT target, source FROM graph
              UNION SELECT DISTINCT b.target, a.source FROM graph a JOIN graph b ON a.target = b.source WHERE a.source <> b.target) reach ON reach.owner = w.contract
        JOIN (SELECT contract, name, unnest(storage_reads) AS v FROM functions) r ON r.contract = reach.reader AND r.v = w.v""",
    "lines": """
        SELECT k, 1 AS ln, 'pragma solidity ^0.8.' || (k % 20) || ';' AS t FROM sup
        UNION ALL SELECT k, 2, 'contract S' || k || ' is N' || nk || ' {' FROM sup
        UNION ALL SELECT k, 3, '    using L' || (k % 3) || ' for uint256;' FROM sup
        UNION ALL SELECT k, 4, '    event E' || k || '(address a);' FROM sup
        UNION ALL SELECT k, 5, '    error X' || k || '(address a);' FROM sup
        UNION ALL SELECT k, 6, '    modifier m' || (k % 5) || '() { _; }' FROM sup
        UNION ALL SELECT k, 7, '    S' || ((7 * k) % n) || ' public t0;' FROM sup
        UNION ALL SELECT k, 8, '    mapping(address => S' || ((7 * k + 1) % n) || ') public t1;' FROM sup
        UNION ALL SELECT k, 9 + j, '    uint256 v' || j || ';' FROM fs
        UNION ALL SELECT k, 19 + 6 * j, '    function ' || name || '(S' || ((3 * k + j) % n) || ' p' || j || ', uint256 x)'
               || [' external', ' public', ' internal', ' private', ''][(k + j) % 5 + 1] || [' view', ' pure', ' payable', ''][(k + j) % 4 + 1]
               || CASE WHEN j % 3 = 0 THEN ' onlyOwner' ELSE '' END || CASE WHEN j % 2 = 0 THEN ' returns (uint256)' ELSE '' END || ' {' FROM fs
        UNION ALL SELECT k, 20 + 6 * j, '        v' || j || ' = v' || ((j + 1) % 10) || ' + x;' FROM fs
        UNION ALL SELECT k, 21 + 6 * j, '        f' || ((j + 2) % 9) || '();' FROM fs
        UNION ALL SELECT k, 22 + 6 * j, '        t' || (j % 3) || '.f' || j || '(x);' FROM fs
        UNION ALL SELECT k, 23 + 6 * j, '        p' || j || '.f' || ((j + 1) % 9) || '(x);' FROM fs
        UNION ALL SELECT k, 24 + 6 * j, '    }' FROM fs
        UNION ALL SELECT k, 79, '}' FROM sup""",
}
_NEEDS = {"fs": ["sup"], "contracts": ["sup"], "functions": ["fs"], "vars": ["sup"], "graph": ["fs"], "cedges": ["functions", "contracts", "vars"], "flows": ["functions", "graph", "contracts"], "lines": ["fs"]}


def _with(names: str, body: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_SHARED[n]})" for n in order) + "\n" if order else "") + body


def register(name: str, shared: str = "", sql: str | None = None):
    """Register a query; with SQL, over the shared definitions named."""

    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = _with(shared, sql)
        return query

    return add


def _as_of():
    return F.lit(A.AS_OF).cast("timestamp_ntz")


def _findings(spark, d):
    rows = N.detectors_of(A.reports(spark, d), ["repo", "key"])
    return N.normalize_findings(rows, ["key"], ["repo", "key"])


def _indexed(spark, d):
    return E.index(A.sources(spark, d))


def _text(*columns):
    """Arrays as text, so that any engine compares them."""
    return [F.array_join(c, ",").alias(c) for c in columns]


def _call_edges(spark, d):
    contracts, functions = _indexed(spark, d)
    return C.call_edges(functions, E.extract_state_vars(contracts), contracts)


# ---- findings ------------------------------------------------------------------------------------

ACTIONABLE = "trim(coalesce(check_type, '')) NOT IN (" + ", ".join(f"'{c}'" for c in N.SKIP_CHECK_TYPES) + ")"
OVERRIDE = "CASE trim(check_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.SEVERITY_OVERRIDES.items()) + " ELSE severity END"
AUTO = "trim(check_type) IN (" + ", ".join(f"'{c}'" for c in N.AUTO_TRUE_POSITIVE_TYPES) + ")"


@register("src_02_read_reports", "findings", "SELECT key, CAST(0 AS INT) AS place FROM findings")
def src_02(spark, d):
    return N.detectors_of(A.reports(spark, d), ["key"]).select("key", "place")


@register("ext_09_normalize_findings", "findings", "SELECT id, 'slither' AS tool, check_type, severity, confidence, description, '' AS invariant_category, false AS verified FROM findings")
def ext_09(spark, d):
    return _findings(spark, d).select("id", "tool", "check_type", "severity", "confidence", "description", "invariant_category", "verified")


@register("ext_10_flatten_elements", "findings", "SELECT id, contract, function, file, line_start, line_end FROM findings")
def ext_10(spark, d):
    return _findings(spark, d).select("id", "contract", "function", "location.*")


@register("udf_02_walk_elements", "findings", "SELECT key, contract, function, file, line_start, line_end FROM findings")
def udf_02(spark, d):
    from ..functions.deep import walk_elements_json

    rows = N.detectors_of(A.reports(spark, d), ["key"])
    return rows.select("key", walk_elements_json(F.get_json_object("detector", "$.elements")).alias("x")).select("key", "x.*")


@register("flt_01_prefilter_findings", "findings", f"SELECT id, check_type FROM findings WHERE {ACTIONABLE}")
def flt_01(spark, d):
    return N.prefilter_findings(_findings(spark, d)).select("id", "check_type")


@register("flt_02_apply_severity_overrides", "findings", f"SELECT id, {OVERRIDE} AS severity FROM findings")
def flt_02(spark, d):
    return N.apply_severity_overrides(_findings(spark, d)).select("id", "severity")


@register("flt_03_flag_auto_true_positive", "findings", f"SELECT id, {AUTO} AS is_auto_true_positive FROM findings")
def flt_03(spark, d):
    return N.flag_auto_true_positive(_findings(spark, d)).select("id", "is_auto_true_positive")


@register("flt_04_finding_summary", "findings", f"SELECT id, check_type, contract, function, {OVERRIDE} AS severity, substring(description, 1, 200) AS description, {AUTO} AS is_auto_true_positive FROM findings")
def flt_04(spark, d):
    return N.finding_summary(_findings(spark, d))


@register(
    "flt_05_finding_detail", "findings",
    """SELECT sha256(concat('E', event_id)) AS id, f.id IS NOT NULL AS known, f.check_type AS check_type,
       CASE WHEN f.id IS NULL THEN 'Error: no finding with id ''' || sha256(concat('E', event_id)) || '''.' END AS error
       FROM (SELECT event_id FROM events) e LEFT JOIN findings f USING (event_id)""",
)
def flt_05(spark, d):
    ids = A.table(spark, d, "events").select(F.sha2(F.concat(F.lit("E"), F.col("event_id").cast("string")), 256).alias("id"))
    detail = N.finding_detail(_findings(spark, d).drop("repo", "key"), ids)
    known = F.get_json_object("detail", "$.id").isNotNull()
    return detail.select("id", known.alias("known"), F.get_json_object("detail", "$.check_type").alias("check_type"), F.when(~known, F.col("detail")).alias("error"))


@register(
    "ag_03_severity_counts", "findings",
    f"""SELECT severity, count(*) AS findings, CAST(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 WHEN 'informational' THEN 5
        WHEN 'optimization' THEN 6 ELSE 7 END AS INT) AS place FROM (SELECT {OVERRIDE} AS severity FROM findings WHERE {ACTIONABLE}) GROUP BY severity""",
)
def ag_03(spark, d):
    """Severity counts of the findings worth acting on: normalise, filter, override, count."""
    return N.severity_counts(N.apply_severity_overrides(N.prefilter_findings(_findings(spark, d))))


@register("set_02_skipped_findings", "findings", f"SELECT id, check_type FROM findings WHERE NOT ({ACTIONABLE})")
def set_02(spark, d):
    return N.skipped_findings(_findings(spark, d)).select("id", "check_type")


def _submissions(spark, d):
    v = A.adapted(spark, d, "verdicts")
    return v.select("batch", F.sha2("key", 256).alias("finding_id"), F.col("is_true_positive").alias("confirmed"), "reason", F.lit(None).cast("string").alias("exploit_scenario"))


VERDICTS = """SELECT f.id AS finding_id, coalesce(v.yes, false) AS is_true_positive, coalesce(v.reason, '') AS reason, '' AS exploit_scenario
       FROM findings f LEFT JOIN (SELECT key, bool_or(is_true_positive) AS yes, max(reason) AS reason FROM verdicts GROUP BY key) v USING (key)"""


@register("jn_11_merge_verdicts", "findings verdicts", VERDICTS)
def jn_11(spark, d):
    return N.merge_verdicts(_findings(spark, d), _submissions(spark, d))


def _verdicts(spark, d):
    return N.merge_verdicts(_findings(spark, d), _submissions(spark, d))


@register("jn_12_true_positives", "findings verdicts", f"SELECT f.id, f.check_type FROM findings f JOIN ({VERDICTS}) v ON v.finding_id = f.id WHERE v.is_true_positive")
def jn_12(spark, d):
    return N.true_positives(_findings(spark, d), _verdicts(spark, d)).select("id", "check_type")


@register("ag_04_verdict_counts", "findings verdicts", f"SELECT 'main' AS repo, count(*) AS total, count(*) FILTER (is_true_positive) AS true_positives, count(*) FILTER (NOT is_true_positive) AS false_positives FROM ({VERDICTS})")
def ag_04(spark, d):
    return N.verdict_counts(_findings(spark, d), _verdicts(spark, d), ["repo"])


def _report_replies(spark, d):
    v = A.adapted(spark, d, "verdicts").withColumn("n", F.expr("CAST(substring(key, 2) AS BIGINT)"))
    odd = lambda text, m: F.when(F.col("n") % m != 0, F.lit(text))
    return v.select(F.sha2("key", 256).alias("finding_id"), odd("critical", 3).alias("severity"), F.lit(None).cast("string").alias("type"), odd("High", 2).alias("difficulty"), odd("Says more.", 5).alias("description"), F.lit(None).cast("string").alias("exploit_scenario"), odd("Fix it.", 7).alias("recommendations"))


ENTRIES = f"""SELECT f.id AS finding_id, CASE WHEN ({OVERRIDE}) <> severity THEN ({OVERRIDE}) WHEN trim(check_type) IN ('timestamp', 'missing-zero-check', 'calls-loop', 'locked-ether', 'reentrancy-unlimited-gas') THEN severity
         WHEN event_id % 3 <> 0 THEN 'critical' ELSE severity END AS severity, check_type AS type,
       CASE WHEN event_id % 2 <> 0 THEN 'High' ELSE 'Medium' END AS difficulty, CASE WHEN event_id % 5 <> 0 THEN 'Says more.' ELSE description END AS description,
       '' AS exploit_scenario, CASE WHEN event_id % 7 <> 0 THEN 'Fix it.' ELSE '' END AS recommendations
       FROM findings f JOIN ({VERDICTS}) v ON v.finding_id = f.id WHERE v.is_true_positive"""


@register("jn_13_report_entries", "findings verdicts", ENTRIES)
def jn_13(spark, d):
    v = _verdicts(spark, d)
    return N.report_entries(N.true_positives(_findings(spark, d), v), v, _report_replies(spark, d))


@register("wn_03_assign_batches", "findings", f"SELECT id, CAST(floor((row_number() OVER (ORDER BY id) - 1) / 10) + 1 AS INT) AS batch, CAST(ceil(count(*) OVER () / 10.0) AS INT) AS batches FROM findings WHERE {ACTIONABLE}")
def wn_03(spark, d):
    return N.assign_batches(N.prefilter_findings(_findings(spark, d)), ["id"]).select("id", "batch", "batches")


@register("wn_04_number_entries", "findings", "SELECT id, contract, CAST(row_number() OVER (PARTITION BY contract ORDER BY id) AS INT) AS number FROM findings")
def wn_04(spark, d):
    return N.number_entries(_findings(spark, d), ["id"], ["contract"]).select("id", "contract", "number")


@register("st_03_findings_table", "findings verdicts", f"SELECT substring(upper(severity), 1, 4) AS severity, check_type AS type, contract, function FROM findings f JOIN ({VERDICTS}) v ON v.finding_id = f.id WHERE v.is_true_positive")
def st_03(spark, d):
    return N.findings_table(N.true_positives(_findings(spark, d), _verdicts(spark, d)))


@register(
    "src_06_report_sections", "findings verdicts",
    f"""SELECT finding_id, '## ' || row_number() OVER (ORDER BY finding_id) || '. ' || type || chr(10) || chr(10) || '- **Severity:** ' || severity || chr(10) || '- **Type:** ' || type || chr(10)
        || '- **Difficulty:** ' || difficulty || chr(10) || chr(10) || '### Description' || chr(10) || chr(10) || description || chr(10) || chr(10) || '### Exploit Scenario' || chr(10) || chr(10)
        || exploit_scenario || chr(10) || chr(10) || '### Recommendations' || chr(10) || chr(10) || recommendations || chr(10) || chr(10) || '---' || chr(10) AS section FROM ({ENTRIES})""",
)
def src_06(spark, d):
    v = _verdicts(spark, d)
    entries = N.report_entries(N.true_positives(_findings(spark, d), v), v, _report_replies(spark, d)).withColumn("repo", F.lit("main"))
    numbered = N.number_entries(entries, ["finding_id"])
    return numbered.select("finding_id", "number").join(S.report_sections(numbered), "number").select("finding_id", "section")


@register(
    "src_06_write_report", "findings verdicts",
    f"""SELECT part, min(n) AS first, max(n) AS last, count(*) AS entries, sha256(CASE WHEN part = '00000' THEN 'HEAD' ELSE '' END || string_agg(section || chr(10), '' ORDER BY n)) AS text_sha256 FROM (
        SELECT CAST(row_number() OVER (ORDER BY finding_id) AS INT) AS n, printf('%05d', (row_number() OVER (ORDER BY finding_id) - 1) // 100) AS part,
        '## ' || row_number() OVER (ORDER BY finding_id) || '. ' || type || chr(10) || chr(10) || '- **Severity:** ' || severity || chr(10) || '- **Type:** ' || type || chr(10)
        || '- **Difficulty:** ' || difficulty || chr(10) || chr(10) || '### Description' || chr(10) || chr(10) || description || chr(10) || chr(10) || '### Exploit Scenario' || chr(10) || chr(10)
        || exploit_scenario || chr(10) || chr(10) || '### Recommendations' || chr(10) || chr(10) || recommendations || chr(10) || chr(10) || '---' || chr(10) AS section FROM ({ENTRIES})) GROUP BY part""".replace("'HEAD'", "'" + "\n".join(S.REPORT_HEAD) + "' || chr(10)"),
)
def src_06_files(spark, d):
    """The report written in files of a hundred entries, and read back by its manifest."""
    v = _verdicts(spark, d)
    entries = N.report_entries(N.true_positives(_findings(spark, d), v), v, _report_replies(spark, d)).withColumn("repo", F.lit("main"))
    path = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    S.write_report(cut(N.number_entries(entries, ["finding_id"])), path, 100)
    return S.read_report(spark, path).select("part", "first", "last", "entries", F.sha2("text", 256).alias("text_sha256"))


@register("src_05_write_findings", "findings", "SELECT id, check_type, severity FROM findings")
def src_05(spark, d):
    """Findings written as JSON lines and read back."""
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    S.write_findings(_findings(spark, d), path)
    return spark.read.schema("id string, check_type string, severity string").json(path)


# ---- replies -------------------------------------------------------------------------------------

BODY = """'{"results":[{"finding_id":"E' || conv_id || '","is_true_positive":' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || ',"reason":"turn {' || turn || '}"}]}'"""
REPLY_JSON = f"CASE WHEN (conv_id + turn) % 3 < 2 THEN {BODY} ELSE 'no json ' || conv_id END"


@register("ext_13_extract_json_reply", "", f"SELECT conv_id, turn, {REPLY_JSON} AS json FROM conversations")
def ext_13(spark, d):
    return R.extract_json_reply(A.replies(spark, d)).select("conv_id", "turn", "json")


@register("udf_03_first_json_object", "", f"SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 < 2 THEN {BODY} END AS json FROM conversations")
def udf_03(spark, d):
    from ..functions.spans import first_json_object

    return A.replies(spark, d).select("conv_id", "turn", first_json_object("raw").alias("json"))


@register("ext_14_extract_fenced_code", "", "SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS code FROM conversations")
def ext_14(spark, d):
    raw = F.concat(F.lit("See\n```solidity\n"), "text", F.lit("\n```\nand\n```\nother\n```"))
    return R.extract_fenced_code(A.table(spark, d, "conversations").filter(F.col("text").isNotNull()).withColumn("raw", raw)).select("conv_id", "turn", "code")


@register("ext_15_parse_verdict_replies", "", "SELECT conv_id, turn, 'E' || conv_id AS finding_id, turn % 2 = 0 AS is_true_positive, 'turn {' || turn || '}' AS reason FROM conversations WHERE (conv_id + turn) % 3 < 2")
def ext_15(spark, d):
    return R.parse_verdict_replies(R.extract_json_reply(A.replies(spark, d)), ["conv_id", "turn"])


@register("ext_16_parse_submissions", "", "SELECT doc_id, 'E' || doc_id AS finding_id, quality = 1 AS confirmed, 'because ' || toxic AS reason, CAST(NULL AS VARCHAR) AS exploit_scenario FROM labels WHERE doc_id % 5 <> 0")
def ext_16(spark, d):
    key = F.concat(F.lit("E"), F.col("doc_id").cast("string"))
    none = F.array().cast("array<string>")
    payload = F.to_json(F.struct(F.when(F.col("quality") == 1, F.array(key)).otherwise(none).alias("finding_ids"), F.create_map(key, F.concat(F.lit("because "), F.col("toxic").cast("string"))).alias("reasons")))
    raw = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(R.SUBMISSION_PREFIX), F.lit("{broken"))).otherwise(F.concat(F.lit(R.SUBMISSION_PREFIX), payload))
    return R.parse_submissions(A.table(spark, d, "labels").withColumn("raw", raw), ["doc_id"])


# ---- history -------------------------------------------------------------------------------------

DAY = "CAST(DATE '2001-08-02' - INTERVAL {} DAY AS TIMESTAMP)"
NEWEST = "row_number() OVER (PARTITION BY {} ORDER BY date DESC, hash)"


@register("ext_11_parse_commit_log", "commits", "SELECT repo, hash, short_hash, author, date, message, message LIKE '%Merge%' AS is_merge FROM commits")
def ext_11(spark, d):
    return H.parse_commit_log(A.log_records(spark, d)).drop("stats")


LOGGED = "SELECT repo, hash, path, CASE WHEN insertions = 1 THEN 0 ELSE insertions END AS insertions, deletions FROM numstat"


@register("ext_12_parse_numstat", "numstat", LOGGED)
def ext_12(spark, d):
    rows = H.parse_commit_log(A.log_records(spark, d)).select("repo", "hash", F.explode("stats").alias("line"))
    return H.parse_numstat(rows, "line", "repo", "hash")


@register(
    "src_03_commit_totals", "commits numstat",
    f"""SELECT c.repo, c.hash, coalesce(n.files, 0) AS files, coalesce(n.i, 0) AS insertions, coalesce(n.x, 0) AS deletions FROM commits c
        LEFT JOIN (SELECT repo, hash, CAST(count(*) AS INT) AS files, CAST(sum(insertions) AS BIGINT) AS i, CAST(sum(deletions) AS BIGINT) AS x FROM ({LOGGED}) GROUP BY repo, hash) n USING (repo, hash)""",
)
def src_03(spark, d):
    rows = H.with_totals(H.parse_commit_log(A.log_records(spark, d)))
    return rows.select("repo", "hash", F.size("files_changed").alias("files"), "insertions", "deletions")


@register("flt_06_recent_commits", "commits", f"SELECT repo, hash, CAST(place AS INT) AS place FROM (SELECT *, {NEWEST.format('repo')} AS place FROM commits WHERE date >= {DAY.format(30)}) WHERE place <= 100")
def flt_06(spark, d):
    return H.recent_commits(A.commits(spark, d), _as_of()).select("repo", "hash", "place")


SECURITY = "regexp_matches(lower(message), '" + "|".join(H.SECURITY_KEYWORDS) + "')"
RISKY = "regexp_matches(lower(message), '" + "|".join(H.RISKY_CHANGE_KEYWORDS) + "')"


@register("flt_07_security_commits", "commits", f"SELECT repo, hash, message FROM commits WHERE {SECURITY}")
def flt_07(spark, d):
    return H.security_commits(A.commits(spark, d)).select("repo", "hash", "message")


@register("flt_08_risky_commits", "commits", f"SELECT repo, hash, message FROM commits WHERE {RISKY}")
def flt_08(spark, d):
    return H.risky_commits(A.commits(spark, d)).select("repo", "hash", "message")


HISTORY = f"SELECT *, {NEWEST.format('repo, path')} AS place FROM (SELECT DISTINCT repo, hash, path FROM numstat) JOIN commits USING (repo, hash)"


@register("flt_09_file_history", "commits numstat", f"SELECT repo, path, hash, CAST(place AS INT) AS place FROM ({HISTORY}) WHERE place <= 50")
def flt_09(spark, d):
    return H.file_history(A.commits(spark, d), A.adapted(spark, d, "numstat")).select("repo", "path", "hash", "place")


CHURN = f"""SELECT repo, path, count(DISTINCT hash) AS commits, CAST(sum(insertions) AS BIGINT) AS total_insertions, CAST(sum(deletions) AS BIGINT) AS total_deletions,
       CAST(sum(insertions + deletions) AS BIGINT) AS total_changes, max(date) AS last_modified FROM numstat JOIN commits USING (repo, hash) WHERE date >= {DAY.format(90)} GROUP BY repo, path"""
AGE = f"floor(epoch({AS_OF_SQL} - last_modified) / 86400)"
VOLATILE = f"SELECT *, commits / (90 / 7.0::DOUBLE) AS f, least(1.0, commits / (90 / 7.0::DOUBLE) * 0.3::DOUBLE + greatest(0.0, 1 - {AGE} / 90) * 0.7::DOUBLE) AS v FROM ({CHURN})"


@register("ag_05_file_churn", "commits numstat", CHURN)
def ag_05(spark, d):
    return H.file_churn(A.commits(spark, d), A.adapted(spark, d, "numstat"), _as_of())


def _volatile(spark, d):
    return H.volatility(H.file_churn(A.commits(spark, d), A.adapted(spark, d, "numstat"), _as_of()), _as_of())


@register("ag_06_volatility", "commits numstat", f"SELECT repo, path, round(f, 6) AS change_frequency, round(v, 6) AS volatility FROM ({VOLATILE})")
def ag_06(spark, d):
    return _volatile(spark, d).select("repo", "path", F.round("change_frequency", 6).alias("change_frequency"), F.round("volatility", 6).alias("volatility"))


@register("ag_07_hotspots", "commits numstat", f"SELECT repo, path, commits, CAST(row_number() OVER (PARTITION BY repo ORDER BY round(v, 9) DESC, path) AS INT) AS place FROM ({VOLATILE}) WHERE commits >= 2")
def ag_07(spark, d):
    return H.hotspots(_volatile(spark, d).withColumn("volatility", F.round("volatility", 9)), 2).select("repo", "path", "commits", "place")


@register(
    "ag_08_blame_share", "blame",
    """SELECT repo, path, line_start, line_end, author, count(*) AS lines, round(count(*) * 100.0 / sum(count(*)) OVER w, 6) AS percent, max(max(author_time)) OVER w AS last_modified
       FROM blame JOIN (SELECT DISTINCT repo, path, unnest([1, 11]) AS line_start, unnest([10, 40]) AS line_end FROM blame) USING (repo, path)
       WHERE line BETWEEN line_start AND line_end GROUP BY repo, path, line_start, line_end, author WINDOW w AS (PARTITION BY repo, path, line_start)""",
)
def ag_08(spark, d):
    blame = A.adapted(spark, d, "blame")
    ranges = blame.select("repo", "path").distinct().select("repo", "path", F.inline(F.array(*(F.struct(F.lit(a).alias("line_start"), F.lit(b).alias("line_end")) for a, b in ((1, 10), (11, 40))))))
    return H.blame_share(blame, ranges).withColumn("percent", F.round("percent", 6))


@register("ag_09_repo_stats", "commits", "SELECT repo, count(*) AS total_commits, count(DISTINCT author) AS contributors, CAST(date_diff('day', min(date), TIMESTAMP '2001-08-02 12:00:00') AS INT) AS repo_age_days FROM commits GROUP BY repo")
def ag_09(spark, d):
    return H.repo_stats(A.commits(spark, d), _as_of())


DAYS = f"floor(epoch({AS_OF_SQL} - date) / 86400)"
RELATIVE = f"""CASE WHEN {DAYS} = 0 THEN 'today' WHEN {DAYS} = 1 THEN 'yesterday' WHEN {DAYS} < 7 THEN CAST(CAST({DAYS} AS BIGINT) AS VARCHAR) || ' days ago'
       WHEN {DAYS} < 30 THEN CAST(CAST(floor({DAYS} / 7) AS BIGINT) AS VARCHAR) || ' weeks ago' ELSE CAST(CAST(floor({DAYS} / 30) AS BIGINT) AS VARCHAR) || ' months ago' END"""


@register("sc_03_relative_age", "commits", f"SELECT repo, hash, {RELATIVE} AS age FROM commits")
def sc_03(spark, d):
    return A.commits(spark, d).select("repo", "hash", T.relative_age(F.col("date"), _as_of()).alias("age"))


@register("sc_04_commit_summary", "", "SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 100) AS summary FROM documents")
def sc_04(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.commit_summary(F.col("text")).alias("summary"))


COMMIT_LINE = f"'  ' || short_hash || ' (' || {RELATIVE} || '): ' || substring(message, 1, 100)"


def _file_findings(spark, d):
    e = A.table(spark, d, "events")
    path = F.concat(F.lit("src/P"), F.col("user_id").cast("string"), F.lit(".sol"))
    return e.select(F.concat(F.lit("R"), (F.col("event_id") % 4).cast("string")).alias("repo"), F.col("event_id").alias("id"), F.struct(path.alias("file")).alias("location"))


@register(
    "jn_10_finding_history_small", "commits numstat",
    f"""SELECT e.id, s.section, CAST(s.place AS INT) AS place, s.line FROM (SELECT 'R' || (event_id % 4) AS repo, event_id AS id, 'src/P' || user_id || '.sol' AS path FROM events) e
        JOIN (SELECT repo, path, 1 AS section, place, {COMMIT_LINE} AS line FROM ({HISTORY}) WHERE place <= 5
              UNION ALL SELECT repo, NULL, 2, place, {COMMIT_LINE} FROM (SELECT *, {NEWEST.format('repo')} AS place FROM (SELECT * FROM (SELECT *, {NEWEST.format('repo')} AS p FROM commits WHERE date >= {DAY.format(30)}) WHERE p <= 100) WHERE {SECURITY}) WHERE place <= 5
              UNION ALL SELECT repo, NULL, 3, place, {COMMIT_LINE} FROM (SELECT *, {NEWEST.format('repo')} AS place FROM (SELECT * FROM (SELECT *, {NEWEST.format('repo')} AS p FROM commits WHERE date >= {DAY.format(30)}) WHERE p <= 100) WHERE {RISKY}) WHERE place <= 5
             ) s ON s.repo = e.repo AND (s.path IS NULL OR s.path = e.path)""",
)
def jn_10(spark, d):
    rows = H.finding_history(_file_findings(spark, d), A.commits(spark, d), A.adapted(spark, d, "numstat"), _as_of())
    return rows.filter("section < 4")  # hotspot lines hold rounded numbers: ag_07 checks them


def history_lines_sql(commits: str, numstat: str, sizes: bool) -> str:
    """repo, path (null: the whole repository's), section, place, line of the four lists of a history."""
    touched = f"SELECT *, {NEWEST.format('repo, path')} AS place FROM (SELECT DISTINCT repo, hash, path FROM {numstat}) JOIN {commits} USING (repo, hash)"
    changed = f"(SELECT repo, path, hash, sum(insertions) AS i, sum(deletions) AS x FROM {numstat} GROUP BY repo, path, hash HAVING sum(insertions) + sum(deletions) > 0)"
    size = f"coalesce(chr(10) || '    +' || CAST(i AS BIGINT) || '/-' || CAST(x AS BIGINT) || ' lines', '')" if sizes else "''"
    recent = f"SELECT * EXCLUDE p FROM (SELECT *, {NEWEST.format('repo')} AS p FROM {commits} WHERE date >= {DAY.format(30)}) WHERE p <= 100"
    listed = lambda n, words: f"SELECT repo, NULL, {n}, place, {COMMIT_LINE} FROM (SELECT *, {NEWEST.format('repo')} AS place FROM ({recent}) WHERE {words}) WHERE place <= 5"
    volatile = VOLATILE.replace("FROM numstat JOIN commits USING", f"FROM {numstat} JOIN {commits} USING")
    return f"""SELECT repo, path, 1 AS section, place, {COMMIT_LINE} || {size} AS line FROM (SELECT * FROM ({touched}) WHERE place <= 5) LEFT JOIN {changed} USING (repo, path, hash)
              UNION ALL {listed(2, SECURITY)} UNION ALL {listed(3, RISKY)}
              UNION ALL SELECT repo, NULL, 4, place, '  ' || path || ': ' || commits || ' changes, volatility=' || printf('%.2f', v)
              FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY v DESC, path) AS place FROM ({volatile}) WHERE commits >= 3) WHERE place <= 5"""


@register(
    "jn_10_finding_history", "commits numstat",
    f"""SELECT e.id, s.section, CAST(s.place AS INT) AS place, s.line FROM (SELECT 'R' || (event_id % 4) AS repo, event_id AS id, 'src/P' || user_id || '.sol' AS path FROM events) e
        JOIN ({history_lines_sql('commits', 'numstat', False)}) s ON s.repo = e.repo AND (s.path IS NULL OR s.path = e.path)""",
)
def jn_10_whole(spark, d):
    return H.finding_history(_file_findings(spark, d), A.commits(spark, d), A.adapted(spark, d, "numstat"), _as_of())


# ---- extraction ----------------------------------------------------------------------------------


@register("ext_01_extract_contracts", "contracts", "SELECT name, contract_type, array_to_string(inherits, ',') AS inherits, path, line_start, line_end FROM contracts")
def ext_01(spark, d):
    return E.extract_contracts(A.sources(spark, d)).select("name", "contract_type", *_text("inherits"), "path", "line_start", "line_end")


@register("udf_01_parse_spans", "contracts functions", "SELECT path, count(*) AS spans, CAST(sum(f.line_end - f.line_start + 1) AS BIGINT) AS lines FROM contracts c JOIN functions f ON f.contract = c.name GROUP BY path")
def udf_01(spark, d):
    functions = E.extract_functions(E.extract_contracts(A.sources(spark, d)))
    return functions.groupBy("path").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("line_end") - F.col("line_start") + 1).alias("lines"))


@register(
    "ext_02_extract_functions", "functions",
    """SELECT contract, name, line_start, line_end, visibility, mutability, array_to_string(modifiers, ',') AS modifiers, array_to_string(parameters, ',') AS parameters,
       array_to_string(return_types, ',') AS return_types, false AS is_constructor, false AS is_fallback, false AS is_receive FROM functions""",
)
def ext_02(spark, d):
    rows = E.extract_functions(E.latest_contracts(E.extract_contracts(A.sources(spark, d))))
    return rows.select("contract", "name", "line_start", "line_end", "visibility", "mutability", *_text("modifiers", "parameters", "return_types"), "is_constructor", "is_fallback", "is_receive")


def _contracts(spark, d):
    return E.latest_contracts(E.extract_contracts(A.sources(spark, d)))


@register("ext_03_extract_state_vars", "vars", "SELECT contract, var, var_type FROM vars")
def ext_03(spark, d):
    return E.extract_state_vars(_contracts(spark, d)).select("contract", "var", "var_type")


@register("ext_04_extract_decls", "sup", "SELECT 'S' || k AS contract, unnest(['event', 'error', 'modifier']) AS kind, unnest(['E' || k, 'X' || k, 'm' || (k % 5)]) AS name FROM sup")
def ext_04(spark, d):
    rows = [E.extract_decls(_contracts(spark, d), kind).select("contract", F.lit(kind).alias("kind"), "name") for kind in ("event", "error", "modifier")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("ext_05_extract_uses", "sup", "SELECT 'S' || k AS contract, 'L' || (k % 3) AS name FROM sup")
def ext_05(spark, d):
    return E.extract_uses(_contracts(spark, d)).select("contract", "name")


@register("ext_06_extract_calls", "functions", "SELECT contract, name, array_to_string(calls, ',') AS calls FROM functions")
def ext_06(spark, d):
    return _indexed(spark, d)[1].select("contract", "name", *_text("calls"))


@register("ext_07_extract_storage_access", "functions", "SELECT contract, name, array_to_string(storage_reads, ',') AS storage_reads, array_to_string(storage_writes, ',') AS storage_writes FROM functions")
def ext_07(spark, d):
    return _indexed(spark, d)[1].select("contract", "name", *_text("storage_reads", "storage_writes"))


@register("ext_08_extract_pragma", "contracts sup", "SELECT c.path, '^0.8.' || (k % 20) AS pragma, '0.8.' || (k % 20) AS version FROM contracts c LEFT JOIN sup ON c.name = 'S' || k")
def ext_08(spark, d):
    return E.extract_pragma(A.sources(spark, d)).select("path", "pragma", "version")


@register(
    "src_01_keep_sources", "docs",
    "SELECT path, length(content) AS chars FROM docs WHERE NOT list_has_any(string_split(path, '/'), ['node_modules', '.git', 'lib', 'cache', 'out', 'artifacts'])",
)
def src_01(spark, d):
    return S.keep_sources(A.adapted(spark, d, "docs")).select("path", F.length("content").cast("long").alias("chars"))


@register(
    "wn_05_latest_definition", "",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1",
)
def wn_05(spark, d):
    rows = A.table(spark, d, "lineitem")
    return E.latest_definition(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


# ---- graph ---------------------------------------------------------------------------------------


@register("gr_01_build_edges", "graph", "SELECT source, target, edge_type, CAST(weight AS INT) AS weight, function, method FROM graph")
def gr_01(spark, d):
    edges = G.build_edges(*_indexed(spark, d))
    return edges.select("source", "target", "edge_type", "weight", F.col("metadata")["function"].alias("function"), F.col("metadata")["calls"].alias("method"))


CLOSURE = """SELECT seed, node, CAST(min(depth) AS INT) AS depth FROM (
       SELECT source AS seed, target AS node, 1 AS depth FROM e UNION ALL SELECT a.source, b.target, 2 FROM e a JOIN e b ON a.target = b.source
       UNION ALL SELECT a.source, c.target, 3 FROM e a JOIN e b ON a.target = b.source JOIN e c ON b.target = c.source) WHERE seed <> node GROUP BY seed, node"""


def _nodes(edges, column):
    return edges.select("repo", F.col(column).alias("seed")).distinct()


@register("gr_02_dependencies", "edges", f"SELECT * FROM (WITH e AS (SELECT DISTINCT source, target FROM edges) {CLOSURE})")
def gr_02(spark, d):
    edges = A.adapted(spark, d, "edges")
    return G.dependencies(edges, _nodes(edges, "source")).select("seed", "node", "depth")


@register("gr_03_dependents", "edges", f"SELECT * FROM (WITH e AS (SELECT DISTINCT target AS source, source AS target FROM edges) {CLOSURE})")
def gr_03(spark, d):
    edges = A.adapted(spark, d, "edges")
    return G.dependents(edges, _nodes(edges, "target")).select("seed", "node", "depth")


def _part_pairs(spark, d, seeds):
    """Each part with each region, by the keys of the tables; seeds: a condition on the key of a part that asks."""
    part = A.table(spark, d, "part").filter(seeds).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("start"))
    ends = A.table(spark, d, "region").select(F.collect_set(F.concat(F.lit("G"), F.col("r_regionkey").cast("string"))).alias("ends"))
    return part.join(F.broadcast(ends)).select(F.lit("main").alias("repo"), "start", F.explode("ends").alias("end"))  # one row of regions


def _hops(edges):
    return edges.select("repo", F.col("source").alias("src"), F.col("target").alias("dst"))


@register(
    "gr_04_call_paths", "edges",
    """, a AS MATERIALIZED (SELECT * FROM edges WHERE source LIKE 'P%' AND CAST(substring(source, 2) AS BIGINT) % 50 = 0)
       SELECT a.source || ' -> ' || a.target || ' -> ' || b.target || ' -> ' || c.target AS path FROM a JOIN edges b ON a.target = b.source JOIN edges c ON b.target = c.source""",
)
def gr_04(spark, d):
    """All paths to regions from the parts of a stated seeds table, ids divisible by 50, over all edges."""
    paths = G.call_paths(_hops(A.adapted(spark, d, "edges")), _part_pairs(spark, d, "p_partkey % 50 = 0"))
    return paths.select(T.flow_text(F.col("path")).alias("path"))


@register(
    "gr_04_path_counts", "edges",
    """SELECT a.source AS start, c.target AS "end", count(*) AS walks FROM edges a JOIN edges b ON a.target = b.source JOIN edges c ON b.target = c.source WHERE a.source LIKE 'P%' GROUP BY a.source, c.target""",
)
def gr_04_counts(spark, d):
    """The number of paths of every pair of part and region, none of them expanded."""
    counts = G.path_counts(_hops(A.adapted(spark, d, "edges")), _part_pairs(spark, d, "true"))
    return counts.select("start", "end", F.col("walks").cast("long").alias("walks"))


@register(
    "gr_04_cyclic_paths", "calls",
    """, asked AS (SELECT 'P' || a.p_partkey AS start, 'P' || b.p_partkey AS "end" FROM part a JOIN part b ON a.p_partkey % 50 = 0 AND b.p_partkey = a.p_partkey % 500 + 1),
       w AS MATERIALIZED (SELECT src, dst FROM calls WHERE src <> dst)
       SELECT start, "end", start || ' -> ' || "end" AS path FROM asked JOIN w ON src = start AND dst = "end"
       UNION ALL SELECT start, "end", start || ' -> ' || a.dst || ' -> ' || "end" FROM asked JOIN w a ON a.src = start JOIN w b ON b.src = a.dst AND b.dst = "end" WHERE a.dst <> "end"
       UNION ALL SELECT start, "end", start || ' -> ' || a.dst || ' -> ' || b.dst || ' -> ' || "end" FROM asked JOIN w a ON a.src = start JOIN w b ON b.src = a.dst JOIN w c ON c.src = b.dst AND c.dst = "end"
       WHERE a.dst <> "end" AND b.dst <> "end" AND b.dst <> start""",
)
def gr_04_cyclic(spark, d):
    """Paths of at most four nodes over the whole cyclic call graph, for a stated pairs table."""
    keys = A.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    ends = keys.select(F.col("k").alias("e"))
    pairs = keys.filter("k % 50 = 0").join(ends, F.col("e") == F.col("k") % 500 + 1).select(F.lit("main").alias("repo"), F.concat(F.lit("P"), F.col("k").cast("string")).alias("start"), F.concat(F.lit("P"), F.col("e").cast("string")).alias("end"))
    return G.call_paths(A.adapted(spark, d, "calls"), pairs, 4).select("start", "end", T.flow_text(F.col("path")).alias("path"))


TOP = "SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, is_external) AS place FROM calls"
SHOW = "'-> ' || dst || CASE WHEN is_external THEN ' [external]' ELSE '' END"


@register(
    "gr_05_call_chain_small", "calls",
    f"""SELECT seed, 'Call chain from ' || seed || ':' || chr(10) || string_agg(line, chr(10) ORDER BY depth, turn, place) AS chain FROM (
        SELECT src AS seed, 0 AS depth, 0 AS turn, place, '  ' || {SHOW} AS line FROM ({TOP}) WHERE place <= 5
        UNION ALL SELECT a.src, 1, a.place, coalesce(b.place, 0), '    ' || coalesce('-> ' || b.dst || CASE WHEN b.is_external THEN ' [external]' ELSE '' END, '(leaf)')
        FROM ({TOP}) a LEFT JOIN (SELECT * FROM ({TOP}) WHERE place <= 5) b ON a.dst = b.src WHERE a.place <= 5 AND a.dst <> a.src) GROUP BY seed""",
)
def gr_05(spark, d):
    calls = A.adapted(spark, d, "calls")
    return G.call_chain(calls, _nodes(calls, "src"), max_depth=1).select("seed", "chain")


def chain_sql(top: str, seeds: str, depth: int) -> str:
    """Definitions top, n0, n1 ... and chain (seed, chain): breadth first, a node at its least turn of the first level that has it."""
    parts = [f"top AS MATERIALIZED (SELECT * FROM ({top}) WHERE place <= 5)", f"n0 AS MATERIALIZED (SELECT DISTINCT seed, seed AS node, CAST([] AS INT[]) AS turn FROM ({seeds}))"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, node FROM n{j}" for j in range(i))
        parts.append(f"""n{i} AS MATERIALIZED (SELECT x.* FROM (SELECT n.seed, t.dst AS node, min(list_append(n.turn, CAST(t.place AS INT))) AS turn FROM n{i - 1} n JOIN top t ON t.src = n.node GROUP BY n.seed, t.dst) x
        ANTI JOIN ({seen}) s ON s.seed = x.seed AND s.node = x.node)""")
    nodes = " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(depth + 1))
    lines = f"""SELECT seed, len(turn) AS depth, turn, coalesce(place, 0) AS place,
        repeat('  ', len(turn) + 1) || coalesce('-> ' || dst || CASE WHEN is_external THEN ' [external]' ELSE '' END, '(leaf)') AS line FROM ({nodes}) LEFT JOIN top ON src = node"""
    parts.append(f"chain AS (SELECT seed, 'Call chain from ' || seed || ':' || chr(10) || string_agg(line, chr(10) ORDER BY depth, turn, place) AS chain FROM ({lines}) GROUP BY seed)")
    return ", " + ",\n".join(parts) + "\n"


@register("gr_05_call_chain", "calls", chain_sql(TOP, "SELECT src AS seed FROM calls", 3) + "SELECT seed, chain FROM chain")
def gr_05_whole(spark, d):
    calls = A.adapted(spark, d, "calls")
    return G.call_chain(calls, _nodes(calls, "src")).select("seed", "chain")


@register(
    "gr_06_dependency_report", "edges",
    f"""WITH x AS (SELECT * FROM (WITH e AS (SELECT DISTINCT source, target FROM edges) {CLOSURE}))
        SELECT seed, 'depends on' AS direction, node, CASE WHEN node LIKE 'S%' THEN '(contract)' ELSE '(external)' END AS label FROM x
        UNION ALL SELECT node, 'used by', seed, '' FROM x""".replace("WITH x AS", ", x AS", 1),
)
def gr_06(spark, d):
    edges = A.adapted(spark, d, "edges")
    known = edges.filter("edge_type = 'inherits'").select("repo", F.col("source").alias("name"), F.lit("contract").alias("contract_type")).distinct()
    deps = G.dependencies(edges, _nodes(edges, "source"))
    return G.dependency_report(deps, G.dependents(edges, _nodes(edges, "target")), known).select("seed", "direction", "node", "label")


@register("ag_01_graph_stats", "contracts functions graph", "SELECT 'main' AS repo, (SELECT count(*) FROM contracts) AS contracts, (SELECT count(*) FROM functions) AS functions, (SELECT count(*) FROM graph) AS edges, (SELECT count(*) FROM contracts) AS files_indexed")
def ag_01(spark, d):
    contracts, functions = _indexed(spark, d)
    return G.graph_stats(contracts, functions, G.build_edges(contracts, functions), A.sources(spark, d))


@register("ag_11_node_tokens", "contracts functions", "SELECT c.name AS contract, CAST(100 + coalesce(sum(50 + 5 * len(calls) + 3 * len(storage_reads) + 3 * len(storage_writes)), 0) AS BIGINT) AS tokens FROM contracts c LEFT JOIN functions f ON f.contract = c.name GROUP BY c.name")
def ag_11(spark, d):
    return G.node_tokens(*_indexed(spark, d)).select("contract", "tokens")


TERMS = "SELECT DISTINCT lower(name) AS term, name AS contract FROM contracts UNION SELECT DISTINCT lower(name), contract FROM functions"


@register("ag_12_build_terms", "contracts functions", TERMS)
def ag_12(spark, d):
    return G.build_terms(*_indexed(spark, d)).select("term", "contract")


ASKED = "SELECT 'S' || n_nationkey AS query FROM nation UNION SELECT substring(n_name, 1, 2) FROM nation UNION SELECT 'xsetVx' UNION SELECT 'g1'"
SEARCHED = f"SELECT query, contract, row_number() OVER (PARTITION BY query ORDER BY max(CASE WHEN term = lower(query) THEN 1 ELSE 0 END) DESC, contract) AS place FROM ({ASKED}) q JOIN ({TERMS}) t ON contains(term, lower(query)) OR contains(lower(query), term) GROUP BY query, contract"


def _asked(spark, d):
    n = A.table(spark, d, "nation")
    more = spark.createDataFrame([("xsetVx",), ("g1",)], "query string")
    return n.select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("query")).union(n.select(F.substring("n_name", 1, 2))).union(more).distinct()


@register("st_01_search", "contracts functions", f"SELECT query, contract, CAST(place AS INT) AS place FROM ({SEARCHED}) WHERE place <= 10")
def st_01(spark, d):
    return G.search(G.build_terms(*_indexed(spark, d)), _asked(spark, d)).select("query", "contract", "place")


# ---- calls ---------------------------------------------------------------------------------------


@register("jn_01_resolve_internal_calls", "cedges", "SELECT src_contract, src_function, dst_contract, dst_function, 'direct' AS call_type FROM cedges WHERE NOT is_external")
def jn_01(spark, d):
    return C.resolve_internal_calls(_indexed(spark, d)[1]).select("src_contract", "src_function", "dst_contract", "dst_function", "call_type")


@register("jn_02_resolve_external_calls", "cedges", "SELECT src_contract, src_function, dst_contract, dst_function FROM cedges WHERE is_external")
def jn_02(spark, d):
    contracts, functions = _indexed(spark, d)
    return C.resolve_external_calls(functions, E.extract_state_vars(contracts), contracts).select("src_contract", "src_function", "dst_contract", "dst_function")


def _flows(spark, d):
    contracts, functions = _indexed(spark, d)
    return C.storage_flows(functions, G.build_edges(contracts, functions))


FLOW_PATH = "c1 || '.' || f1 || ' -> ' || c2 || '.' || f2"


@register("jn_03_storage_flows", "flows", f"SELECT {FLOW_PATH} AS path, var AS source_var, var AS target_var, 'storage' AS flow_type, tainted AS is_tainted FROM flows")
def jn_03(spark, d):
    return _flows(spark, d).select(T.flow_text(F.col("path")).alias("path"), "source_var", "target_var", "flow_type", "is_tainted")


@register("flt_12_flag_tainted", "functions", "SELECT contract, name, regexp_matches(lower(name), 'deposit|withdraw|transfer|approve|mint|burn|set|update|change|add|remove|initialize') AS is_tainted FROM functions")
def flt_12(spark, d):
    return C.flag_tainted(_indexed(spark, d)[1]).select("contract", "name", "is_tainted")


@register("flt_10_trace_data_flow", "flows vars", f"SELECT v.contract, v.var, {FLOW_PATH} AS path FROM vars v JOIN flows f ON f.c1 = v.contract AND f.var = v.var")
def flt_10(spark, d):
    contracts, _ = _indexed(spark, d)
    return C.trace_data_flow(_flows(spark, d), E.extract_state_vars(contracts)).select("contract", "var", T.flow_text(F.col("path")).alias("path"))


@register("jn_04_breaking_changes", "cedges functions", "SELECT dst_contract AS contract, dst_function AS function, src_contract AS affected_contract, src_function AS affected_function, is_external FROM cedges JOIN functions f ON f.contract = dst_contract AND f.name = dst_function")
def jn_04(spark, d):
    functions = _indexed(spark, d)[1]
    return C.breaking_changes(_call_edges(spark, d), functions.select("repo", "contract", F.col("name").alias("function"))).drop("repo", "call_type")


REENTRANT = "SELECT src_contract AS contract, src_function AS function, src_contract || '.' || src_function || ' -> ' || string_agg(dst_contract || '.' || dst_function, ' -> ' ORDER BY dst_contract || '.' || dst_function) AS path FROM cedges WHERE is_external GROUP BY 1, 2"


@register("jn_05_reentrancy_paths", "cedges", REENTRANT)
def jn_05(spark, d):
    return C.reentrancy_paths(_indexed(spark, d)[1], _call_edges(spark, d)).select("contract", "function", T.flow_text(F.col("path")).alias("path"))


@register(
    "ag_02_call_graph_stats", "cedges flows",
    """SELECT 'main' AS repo, count(*) AS total_edges, count(*) FILTER (is_external) AS external_calls, count(*) FILTER (NOT is_external) AS internal_calls,
       count(DISTINCT src_contract || '.' || src_function) AS unique_source_functions, count(DISTINCT dst_contract || '.' || dst_function) AS unique_target_functions,
       (SELECT count(*) FROM flows) AS data_flows FROM cedges""",
)
def ag_02(spark, d):
    return C.call_graph_stats(_call_edges(spark, d), _flows(spark, d))


@register("sc_08_qualified_name", "functions", "SELECT contract || '.' || name AS qualified FROM functions")
def sc_08(spark, d):
    return _indexed(spark, d)[1].select(T.qualified_name(F.col("contract"), F.col("name")).alias("qualified"))


# ---- context -------------------------------------------------------------------------------------

MATCHED = """SELECT f.id, f.contract, f.function, f.file, f.line_start, f.line_end, s.k FROM findings f JOIN sup s ON f.contract = 'S' || s.k WHERE f.file <> ''"""


@register("jn_07_match_paths", "findings sup", f"SELECT id, 'src/S' || k || '.sol' AS path FROM ({MATCHED})")
def jn_07(spark, d):
    return X.match_paths(_findings(spark, d), A.sources(spark, d)).select("id", "path")


@register(
    "jn_06_source_window", "findings sup lines",
    f"""SELECT id, '=== Source: ' || any_value(file) || ' ===' || chr(10) || string_agg('>>> ' || lpad(CAST(ln AS VARCHAR), CAST(greatest(4, length(CAST(ln AS VARCHAR))) AS INTEGER), ' ') || ' | ' || t, chr(10) ORDER BY ln) AS content
        FROM ({MATCHED}) m JOIN lines l ON l.k = m.k AND l.ln BETWEEN greatest(1, line_start - 20) AND least(79, line_end + 19) GROUP BY id""",
)
def jn_06(spark, d):
    return X.source_window(_findings(spark, d), A.sources(spark, d))


def _texts(spark, d):
    return X.contract_text(*_indexed(spark, d))


#: The description of each contract; {focus} marks a function.
CONTRACT_TEXT = """SELECT 'S' || sup.k AS name, '=== S' || sup.k || ' (contract) in src/S' || sup.k || '.sol ===' || chr(10) || 'Lines: 2-79' || chr(10) || 'Inherits: N' || nk || chr(10) || 'State Variables:' || chr(10)
       || v.t || chr(10) || 'Functions:' || chr(10) || f.t || chr(10) || 'Events: E' || sup.k || chr(10) || 'Errors: X' || sup.k AS text FROM sup
       JOIN (SELECT contract, string_agg('  - ' || var_type || ' ' || var, chr(10) ORDER BY '  - ' || var_type || ' ' || var) AS t FROM vars GROUP BY contract) v ON v.contract = 'S' || sup.k
       JOIN ({functions}) f ON f.contract = 'S' || sup.k
       UNION ALL SELECT c.name, '=== ' || c.name || ' (' || contract_type || ') in ' || path || ' ===' || chr(10) || 'Lines: 1-5' || chr(10) || 'Functions:' || chr(10) || f.t FROM contracts c
       JOIN ({functions}) f ON f.contract = c.name WHERE c.name LIKE 'N%'"""
FUNCTION_LINES = """SELECT contract, string_agg('  - ' || visibility || ' ' || mutability || ' ' || name || '(' || array_to_string(parameters, ', ') || ')' || chr(10)
       || '    Calls: ' || array_to_string(calls[1:5], ', ') || chr(10) || '    Writes: ' || array_to_string(storage_writes[1:5], ', '), chr(10) ORDER BY line_start) AS t FROM functions GROUP BY contract"""
PLAIN_TEXT = CONTRACT_TEXT.format(functions=FUNCTION_LINES)


@register("sc_06_contract_text", "sup vars functions contracts", PLAIN_TEXT)
def sc_06(spark, d):
    return _texts(spark, d).select("name", X.with_focus().alias("text"))


FOCUSED = f"""SELECT f.id, replace(t.text, ' ' || f.function || '(', ' ' || f.function || '(') AS text FROM findings f JOIN ({PLAIN_TEXT}) t ON t.name = f.contract"""
FOCUS_TEXT = """regexp_replace(t.text, '(\\n  - [a-z]+ [a-z]+ ' || f.function || '\\([^\\n]*\\))\\n', '\\1 [FOCUS]' || chr(10))"""


@register("jn_08_finding_contracts", "findings sup vars functions contracts", f"SELECT f.id, {FOCUS_TEXT} AS content FROM findings f JOIN ({PLAIN_TEXT}) t ON t.name = f.contract")
def jn_08(spark, d):
    return X.finding_contracts(_findings(spark, d), _texts(spark, d))


DEPENDENCY_TEXTS = f"""SELECT f.id, CAST(row_number() OVER (PARTITION BY f.id ORDER BY t.name) AS INT) AS place, t.text AS content FROM findings f
        JOIN (SELECT DISTINCT source, target FROM graph) g ON g.source = f.contract JOIN ({PLAIN_TEXT}) t ON t.name = g.target"""


@register("jn_09_finding_dependencies", "findings sup vars functions contracts graph", DEPENDENCY_TEXTS)
def jn_09(spark, d):
    contracts, functions = _indexed(spark, d)
    return X.finding_dependencies(_findings(spark, d), G.build_edges(contracts, functions), X.contract_text(contracts, functions))


def packed_sql(budget: int) -> str:
    """Contract and direct dependencies by name up to the first that overflows; indexed dependencies have none of their own here, so two hops add nothing."""
    return f"""WITH t AS MATERIALIZED ({PLAIN_TEXT}), parts AS (SELECT f.id, 0 AS place, '' AS name, {FOCUS_TEXT} AS content FROM findings f JOIN t ON t.name = f.contract
             UNION ALL SELECT f.id, 1, t.name, t.text FROM findings f JOIN (SELECT DISTINCT source, target FROM graph) g ON g.source = f.contract JOIN t ON t.name = g.target),
        run AS (SELECT *, sum(length(content) // 4) OVER (PARTITION BY id ORDER BY place, name ROWS UNBOUNDED PRECEDING) AS used FROM parts)
        SELECT f.id, coalesce(p.context, 'No relevant context found.') AS context FROM findings f LEFT JOIN (SELECT id, string_agg(content, chr(10) || chr(10) ORDER BY place, name) AS context FROM run WHERE used <= {budget} GROUP BY id) p USING (id)""".replace("WITH t AS", ", t AS", 1)


@register("wn_02_pack_contracts_small", "findings sup vars functions contracts graph", packed_sql(420))
def wn_02(spark, d):
    contracts, functions = _indexed(spark, d)
    return X.pack_contracts(_findings(spark, d), X.contract_text(contracts, functions), G.build_edges(contracts, functions), 420)


def _cut_index(spark, d):
    """Contracts and functions, parsed once for all that reads them."""
    contracts = shuffled(cut(_contracts(spark, d)))
    return contracts, shuffled(cut(E.extract_storage_access(E.extract_calls(E.extract_functions(contracts)))))


@register("wn_02_pack_contracts", "findings sup vars functions contracts graph", packed_sql(15_000))
def wn_02_whole(spark, d):
    contracts, functions = _cut_index(spark, d)
    return X.pack_contracts(_findings(spark, d), X.contract_text(contracts, functions), G.build_edges(contracts, functions))


def _lookups(spark, d, *most_chars):
    contracts, functions = _indexed(spark, d)
    texts = X.contract_text(contracts, functions).select("repo", "name", X.with_focus().alias("text"))
    names = A.table(spark, d, "events").select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("name")).union(spark.createDataFrame([("G1",)], "name string")).distinct()
    return G.contract_lookup(texts, G.build_terms(contracts, functions), names.select(F.lit("main").alias("repo"), "name"), *most_chars).select("name", "answer")


def lookup_sql(most: int) -> str:
    return f"""WITH asked AS (SELECT DISTINCT 'S' || user_id AS name FROM events UNION SELECT 'G1'), hit AS (SELECT a.name, t.text FROM asked a LEFT JOIN ({PLAIN_TEXT}) t USING (name)),
        near AS (SELECT query, string_agg(contract, ', ' ORDER BY place) AS xs FROM (SELECT query, contract, row_number() OVER (PARTITION BY query ORDER BY max(CASE WHEN term = lower(query) THEN 1 ELSE 0 END) DESC, contract) AS place
                 FROM (SELECT name AS query FROM hit WHERE text IS NULL) q JOIN ({TERMS}) t ON contains(term, lower(query)) OR contains(lower(query), term) GROUP BY query, contract) WHERE place <= 5 GROUP BY query)
        SELECT name, CASE WHEN text IS NOT NULL THEN CASE WHEN length(text) <= {most} THEN text ELSE substring(text, 1, {most} - 23) || chr(10) || '... (output truncated)' END
               WHEN xs IS NULL THEN 'Contract ''' || name || ''' not found in the codebase.' ELSE 'Contract ''' || name || ''' not found. Did you mean: ' || xs || '?' END AS answer
        FROM hit LEFT JOIN near ON near.query = hit.name""".replace("WITH asked AS", ", asked AS", 1)


@register("st_02_contract_lookup_small", "sup vars functions contracts", lookup_sql(600))
def st_02(spark, d):
    return _lookups(spark, d, 600)


@register("st_02_contract_lookup", "sup vars functions contracts", lookup_sql(4000))
def st_02_whole(spark, d):
    return _lookups(spark, d)


CHAIN_TOP = "SELECT src_contract || '.' || src_function AS src, dst_contract || '.' || dst_function AS dst, is_external, row_number() OVER (PARTITION BY src_contract, src_function ORDER BY dst_contract || '.' || dst_function, is_external) AS place FROM cedges"


def call_context_sql(depth: int) -> str:
    return chain_sql(CHAIN_TOP, "SELECT contract || '.' || function AS seed FROM findings", depth) + f""",
        paths AS (SELECT contract, string_agg('  ' || path, chr(10) ORDER BY function) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY function) AS p FROM ({REENTRANT})) WHERE p <= 3 GROUP BY contract),
        callers AS (SELECT c, f, string_agg(line, chr(10) ORDER BY p) AS callers FROM (SELECT dst_contract AS c, dst_function AS f, '  ' || src_contract || '.' || src_function || CASE WHEN is_external THEN ' (external)' ELSE ' (internal)' END AS line,
            row_number() OVER (PARTITION BY dst_contract, dst_function ORDER BY src_contract, src_function, is_external) AS p FROM cedges) WHERE p <= 5 GROUP BY c, f)
        SELECT id, '=== Call Graph Context ===' || chr(10) || chain || coalesce(chr(10) || chr(10) || 'Potential reentrancy paths:' || chr(10) || paths, '') || coalesce(chr(10) || chr(10) || 'Breaking change impact:' || chr(10) || callers, '') AS content
        FROM findings f JOIN chain ON seed = f.contract || '.' || f.function LEFT JOIN paths ON paths.contract = f.contract LEFT JOIN callers ON callers.c = f.contract AND callers.f = f.function"""


@register("jn_14_finding_call_context_small", "findings cedges functions", call_context_sql(1))
def jn_14(spark, d):
    return X.finding_call_context(_findings(spark, d), _call_edges(spark, d), _indexed(spark, d)[1], 1)


@register("jn_14_finding_call_context", "findings cedges functions", call_context_sql(5))
def jn_14_whole(spark, d):
    contracts, functions = _cut_index(spark, d)
    calls = cut(C.call_edges(functions, E.extract_state_vars(contracts), contracts))
    return X.finding_call_context(cut(_findings(spark, d)), calls, functions)


FLOW_TEXTS = f"""SELECT f.id, '=== Data Flow Context ===' || chr(10) || 'Reads: ' || array_to_string(storage_reads[1:10], ', ') || chr(10) || 'Writes: ' || array_to_string(storage_writes[1:10], ', ')
        || coalesce(chr(10) || chr(10) || 'Data flow for ' || storage_writes[1] || ':' || chr(10) || x.t, '') AS content
        FROM findings f JOIN functions g ON g.contract = f.contract AND g.name = f.function
        LEFT JOIN (SELECT c1, var, string_agg(line, chr(10) ORDER BY line) AS t FROM (SELECT c1, var, '  ' || {FLOW_PATH} || ' (storage)' AS line, row_number() OVER (PARTITION BY c1, var ORDER BY '  ' || {FLOW_PATH} || ' (storage)') AS p FROM flows) WHERE p <= 3 GROUP BY c1, var) x
        ON x.c1 = f.contract AND x.var = storage_writes[1]"""


@register("jn_15_finding_flow_context", "findings functions flows", FLOW_TEXTS)
def jn_15(spark, d):
    contracts, functions = _cut_index(spark, d)
    return X.finding_flow_context(_findings(spark, d), functions, C.storage_flows(functions, G.build_edges(contracts, functions)))


FINDING_TEXT = """'=== Finding: ' || check_type || ' ===' || chr(10) || 'Severity: ' || severity || chr(10) || 'Confidence: ' || confidence || chr(10) || 'Contract: ' || contract || chr(10) || 'Function: ' || function
       || chr(10) || 'Description: ' || substring(description, 1, 500) || CASE WHEN file <> '' THEN chr(10) || 'File: ' || file || chr(10) || 'Lines: ' || line_start || '-' || line_end ELSE '' END"""


@register("sc_07_finding_text", "findings", f"SELECT id, {FINDING_TEXT} AS text FROM findings")
def sc_07(spark, d):
    return _findings(spark, d).select("id", X.finding_text().alias("text"))


def _elements(spark, d):
    findings = _findings(spark, d)
    return X.context_elements({"finding": findings.select("id", X.finding_text().alias("content")), "semantic_graph": X.finding_contracts(findings, _texts(spark, d)), "source": X.source_window(findings, A.sources(spark, d))})


ELEMENTS = f"""SELECT id, 0 AS seq, {FINDING_TEXT} AS content, 1.0::DOUBLE AS relevance, 'finding' AS source FROM findings
       UNION ALL SELECT id, 100000, '=== Source: ' || any_value(file) || ' ===' || chr(10) || string_agg('>>> ' || lpad(CAST(ln AS VARCHAR), CAST(greatest(4, length(CAST(ln AS VARCHAR))) AS INTEGER), ' ') || ' | ' || t, chr(10) ORDER BY ln), 0.95, 'source'
       FROM ({MATCHED}) m JOIN lines l ON l.k = m.k AND l.ln BETWEEN greatest(1, line_start - 20) AND least(79, line_end + 19) GROUP BY id
       UNION ALL SELECT f.id, 200000, {FOCUS_TEXT}, 0.9, 'semantic_graph' FROM findings f JOIN ({PLAIN_TEXT}) t ON t.name = f.contract"""


@register("set_01_context_elements_small", "findings sup lines vars functions contracts", f"SELECT id, CAST(seq AS INT) AS seq, length(content) AS chars, CAST(1 AS INT) AS priority, source, CAST(floor(length(content) * 0.25) AS INT) AS tokens, relevance FROM ({ELEMENTS})")
def set_01(spark, d):
    return _elements(spark, d).select("id", "seq", F.length("content").cast("long").alias("chars"), "priority", "source", "tokens", "relevance")


@register(
    "wn_01_pack_context_small", "findings sup lines vars functions contracts",
    f""", e AS MATERIALIZED (SELECT *, CAST(floor(length(content) * 0.25) AS INT) AS tokens FROM ({ELEMENTS})),
        r AS (SELECT *, sum(tokens) OVER (PARTITION BY id ORDER BY relevance DESC ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY id ORDER BY relevance DESC) AS place FROM e),
        o AS (SELECT *, min(CASE WHEN run > 700 THEN place END) OVER (PARTITION BY id) AS over FROM r),
        c AS (SELECT id, place, CASE WHEN run <= 700 THEN content ELSE substring(content, 1, CAST(4 * (700 - run + tokens) AS INT)) || chr(10) || '... (context truncated)' END AS content, CASE WHEN run <= 700 THEN tokens ELSE 0 END AS tokens
              FROM o WHERE run <= 700 OR (place = over AND 700 - run + tokens > 200))
        SELECT id, string_agg(content, chr(10) || chr(10) ORDER BY place) AS context, CAST(sum(tokens) AS BIGINT) AS used FROM c GROUP BY id""",
)
def wn_01(spark, d):
    return X.pack_context(_elements(spark, d), 700)


def _history(spark, d):
    """The commits and numstat rows as the history of the one repository with sources; paths are those of sources."""
    commits = A.commits(spark, d).withColumn("repo", F.lit("main"))
    return commits, A.adapted(spark, d, "numstat").withColumn("repo", F.lit("main")).withColumn("path", F.regexp_replace("path", "^src/P", "src/S"))


#: The history of the one repository with sources, as :func:`_history` makes it.
MAIN_HISTORY = """, hc AS MATERIALIZED (SELECT * REPLACE ('main' AS repo) FROM commits), hn AS MATERIALIZED (SELECT * REPLACE ('main' AS repo, regexp_replace(path, '^src/P', 'src/S') AS path) FROM numstat),
       """
_HEADS = " ".join(f"WHEN {n} THEN '{text}'" for n, text in enumerate(H.HEADINGS, 1) if text)
HISTORY_TEXTS = f"""SELECT f.id, coalesce(h.content, '{H.NO_HISTORY}') AS content FROM findings f LEFT JOIN (
           SELECT f.id, string_agg(CASE WHEN s.place > 1 THEN '' WHEN s.section = 1 THEN '=== Recent changes to ' || f.file || ' ===' || chr(10) ELSE CASE s.section {_HEADS} END END || s.line, chr(10) ORDER BY s.section, s.place) AS content
           FROM findings f JOIN hl s ON s.path IS NULL OR s.path = f.file GROUP BY f.id) h USING (id)"""
HISTORY_LISTS = f"hl AS MATERIALIZED ({history_lines_sql('hc', 'hn', True)})"


@register("jn_10_history_text", "findings commits numstat", f"{MAIN_HISTORY}{HISTORY_LISTS} {HISTORY_TEXTS}")
def jn_10_text(spark, d):
    return H.history_text(_findings(spark, d), *_history(spark, d), _as_of())


def _all_elements(spark, d):
    """The elements of all eight kinds."""
    return X.all_elements(cut(_findings(spark, d)), A.sources(spark, d), *_cut_index(spark, d), *_history(spark, d), _as_of())


_CALL_DEFINITIONS, _, CALL_TEXTS = call_context_sql(5).rpartition("        SELECT id, '=== Call Graph Context")
CALL_TEXTS = "SELECT id, '=== Call Graph Context" + CALL_TEXTS
STRUCTURE_TEXT = """'=== Project Structure ===' || chr(10) || 'Contracts: ' || (SELECT count(*) FROM contracts) || chr(10) || 'Functions: ' || (SELECT count(*) FROM functions) || chr(10) || 'Dependencies: '
       || (SELECT count(*) FROM graph) || chr(10) || 'Commits: ' || (SELECT count(*) FROM hc) || chr(10) || 'Contributors: ' || (SELECT count(DISTINCT author) FROM hc)"""
#: All eight kinds of elements, from the SQL of each.
ALL_ELEMENTS = f"""{_CALL_DEFINITIONS.rstrip()}{MAIN_HISTORY}{HISTORY_LISTS},
       el AS MATERIALIZED (SELECT *, 1 AS priority FROM ({ELEMENTS})
       UNION ALL SELECT id, 300000 + place, content, 0.7, 'dependency', 2 FROM ({DEPENDENCY_TEXTS}) UNION ALL SELECT id, 400000, content, 0.8, 'call_graph', 2 FROM ({CALL_TEXTS})
       UNION ALL SELECT id, 500000, content, 0.6, 'data_flow', 3 FROM ({FLOW_TEXTS}) UNION ALL SELECT id, 600000, content, 0.4, 'git', 4 FROM ({HISTORY_TEXTS})
       UNION ALL SELECT id, 700000, {STRUCTURE_TEXT}, 0.2, 'structure', 4 FROM findings)"""
ELEMENT_TABLES = "findings sup lines vars functions contracts graph cedges flows commits numstat"


@register(
    "set_01_context_elements", ELEMENT_TABLES,
    f"{ALL_ELEMENTS} SELECT id, CAST(seq AS INT) AS seq, length(content) AS chars, priority, source, CAST(floor(length(content) * 0.25) AS INT) AS tokens, relevance, sha256(content) AS content_sha256 FROM el",
)
def set_01_whole(spark, d):
    return _all_elements(spark, d).select("id", "seq", F.length("content").cast("long").alias("chars"), "priority", "source", "tokens", "relevance", F.sha2("content", 256).alias("content_sha256"))


@register(
    "wn_01_pack_context", ELEMENT_TABLES,
    f"""{ALL_ELEMENTS}, et AS (SELECT *, CAST(floor(length(content) * 0.25) AS INT) AS tokens FROM el),
        r AS (SELECT *, sum(tokens) OVER w AS run, row_number() OVER w AS place FROM et WINDOW w AS (PARTITION BY id ORDER BY priority, relevance DESC, seq ROWS UNBOUNDED PRECEDING)),
        o AS (SELECT *, min(CASE WHEN run > 30000 THEN place END) OVER (PARTITION BY id) AS over FROM r),
        c AS (SELECT id, place, CASE WHEN run <= 30000 THEN content ELSE substring(content, 1, CAST(4 * (30000 - run + tokens) AS INT)) || chr(10) || '... (context truncated)' END AS content, CASE WHEN run <= 30000 THEN tokens ELSE 0 END AS tokens
              FROM o WHERE run <= 30000 OR (place = over AND 30000 - run + tokens > 200))
        SELECT id, string_agg(content, chr(10) || chr(10) ORDER BY place) AS context, CAST(sum(tokens) AS BIGINT) AS used FROM c GROUP BY id""",
)
def wn_01_whole(spark, d):
    return X.pack_context(_all_elements(spark, d))


@register("wn_06_first_n_per_key", "calls", f"SELECT src, dst, CAST(place AS INT) AS place FROM ({TOP}) WHERE place <= 5")
def wn_06(spark, d):
    return G.first_n_per_key(A.adapted(spark, d, "calls"), ["src"], ["dst", "is_external"], 5).select("src", "dst", "place")


@register(
    "ag_10_project_overview", "contracts functions",
    "SELECT c.name, c.contract_type, count(f.name) AS functions, (SELECT count(*) FROM contracts) AS project_contracts, (SELECT count(*) FROM functions) AS project_functions FROM contracts c LEFT JOIN functions f ON f.contract = c.name GROUP BY c.name, c.contract_type",
)
def ag_10(spark, d):
    return X.project_overview(*_indexed(spark, d)).drop("repo")


_GREP_SQL = """, l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM docs),
       h AS (SELECT path, n, path || ':' || n || ':' || text AS line FROM l WHERE regexp_matches(text, 'licen[sc]e|License')),
       t AS (SELECT coalesce(string_agg(line, chr(10) ORDER BY path, n), '(no matches)') AS r FROM h)
       SELECT 'main' AS repo, CASE WHEN length(r) <= 4000 THEN r ELSE substring(r, 1, 4000 - 23) || chr(10) || '... (output truncated)' END AS result FROM t"""


@register("flt_11_grep", "docs", _GREP_SQL)
def flt_11(spark, d):
    return X.grep(A.adapted(spark, d, "docs"), "licen[sc]e|License", "*.sol")


@register("flt_11_grep_by_trigrams", "docs", _GREP_SQL)
def flt_11_by_trigrams(spark, d):
    """The same through an index of all documents."""
    docs = A.adapted(spark, d, "docs")
    return X.grep(docs, "licen[sc]e|License", "*.sol", postings=P.trigram_postings(docs))


@register(
    "flt_11_trigram_postings", "docs",
    """, l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line FROM docs),
       t AS (SELECT DISTINCT repo, path, substring(line, i::BIGINT, 3) AS trigram FROM (SELECT repo, path, line, unnest(range(1, length(line) - 1)) AS i FROM l))
       SELECT trigram, CAST(count(*) AS BIGINT) AS files, min(path) AS first_path FROM t GROUP BY trigram""",
)
def flt_11_postings(spark, d):
    """In how many documents each trigram stands, and the first of them."""
    return P.trigram_postings(A.adapted(spark, d, "docs")).groupBy("trigram").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"))


@register("sc_01_truncate_text", "", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500 - 23) || chr(10) || '... (output truncated)' END AS cut FROM documents")
def sc_01(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.truncate_text(F.col("text"), 500).alias("cut"))


@register("sc_02_cap_text", "", "SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE substring(text, 1, 500) || chr(10) || '// ... truncated' END AS cut FROM documents")
def sc_02(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.cap_text(F.col("text"), 500).alias("cut"))


@register("sc_05_list_to_text", "", "SELECT l_orderkey, string_agg(l_returnflag, chr(10) ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def sc_05(spark, d):
    rows = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_returnflag")).alias("xs"))
    return rows.select("l_orderkey", T.list_to_text(F.col("xs")).alias("flags"))


@register("src_04_blame_lines", "blame", "SELECT path, CAST(count(*) AS BIGINT) AS lines, count(DISTINCT author) AS authors FROM blame GROUP BY path")
def src_04(spark, d):
    """Porcelain blame made of the blame table, file by file, and read back."""
    blame = A.adapted(spark, d, "blame").withColumn("hash", F.substring(F.sha2(F.concat_ws("|", "author", "author_time"), 256), 1, 40))
    return S.blame_lines(S.porcelain(blame)).groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("author").alias("authors"))


@register("src_04_read_blame", "long_blame", "SELECT path, line, author, author_time FROM long_blame")
def src_04_files(spark, d):
    """A few long files' blame as files of porcelain, each read by many tasks."""
    blame = A.adapted(spark, d, "long_blame").withColumn("hash", F.substring(F.sha2(F.concat_ws("|", "author", "author_time"), 256), 1, 40))
    path = f"{shared_folder(spark)}/blame-{uuid.uuid4().hex}"
    rows = S.porcelain_lines(blame).repartition("path").sortWithinPartitions("path", "line")
    rows.select(F.concat("path", F.lit(".blame")).alias("file"), F.col("row").alias("value")).write.partitionBy("file").text(path)
    return S.read_blame(spark, f"{path}/*/*", "main").select("path", "line", "author", "author_time")


@register(
    "str_01_stream_index", "contracts functions graph",
    f"""SELECT c.name, contract_type, path, line_start, line_end, coalesce(t.n, 0) AS terms, coalesce(f.n, 0) AS functions, coalesce(g.n, 0) AS edges FROM contracts c
        LEFT JOIN (SELECT contract, count(*) AS n FROM ({TERMS}) GROUP BY contract) t ON t.contract = c.name
        LEFT JOIN (SELECT contract, count(*) AS n FROM functions GROUP BY contract) f ON f.contract = c.name
        LEFT JOIN (SELECT source, count(*) AS n FROM graph GROUP BY source) g ON g.source = c.name""",
)
def str_01(spark, d):
    """Sources as a stream of files in two goes: an older version of each with another contract and function, then what it is now.

    The second go starts from the first one's checkpoint; the tables must have nothing of what left the files.
    """
    from ..streaming.index import FILES, IndexTables, stream_index

    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    now, tables = A.sources(spark, d), IndexTables(spark, f"{root}/tables")
    name = F.regexp_extract("path", r"(\w+)\.sol$", 1)
    older = F.concat(F.regexp_replace("content", r"\}$", "    function gone(uint256 z) {\n        q.was(z);\n    }\n}\n"), F.lit("contract Old"), name, F.lit(" is Base {\n    function left() public {\n    }\n}\n"))
    for version, content in ((1, older), (2, F.col("content"))):
        now.select("repo", "path", F.lit(version).cast("long").alias("version"), content.alias("content")).write.mode("append").parquet(f"{root}/files")
        stream_index(spark.readStream.schema(FILES).parquet(f"{root}/files"), tables, f"{root}/checkpoint").awaitTermination()
    found = tables.read()
    rows = found["contracts"].select("name", "contract_type", "path", "line_start", "line_end")
    for table in ("terms", "functions", "edges"):
        counted = found[table].groupBy(F.col("contract").alias("name")).agg(F.count(F.lit(1)).alias(table))
        rows = rows.join(counted, "name", "left")
    return rows.na.fill(0)
