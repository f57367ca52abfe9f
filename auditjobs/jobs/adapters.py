"""The given tables in the roles of source trees, call graphs, histories and findings.

SQL here is plain enough for any engine, so the oracle reads the same inputs. Source
files and reports are text made in Spark alone: the oracle derives their facts by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shuffled

TABLES = "region nation customer supplier part orders lineitem events documents conversations labels pages".split()
AS_OF = "2001-08-02 12:00:00"

#: Check types in turn.
CHECKS = [
    "reentrancy-eth", "solc-version", "timestamp", "calls-loop", "naming-convention", "locked-ether", "unused-return", "missing-zero-check",
    "pragma", "arbitrary-send-eth", "shadowing-local", "weak-prng", "reentrancy-unlimited-gas", "low-level-calls", "divide-before-multiply", " tx-origin",
]

_CHECK = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CHECKS)) + " END"

SQL = {
    "commits": """
        SELECT concat('R', CAST(o_orderkey % 4 AS STRING)) AS repo, lpad(CAST(o_orderkey AS STRING), 40, '0') AS hash,
               substring(lpad(CAST(o_orderkey AS STRING), 40, '0'), 34, 7) AS short_hash,
               concat('dev_', CAST(o_custkey AS STRING)) AS author, o_orderdate AS date,
               concat(CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Emergency fix ' WHEN '2' THEN 'Refactor module '
                      WHEN '3' THEN 'Add feature ' WHEN '4' THEN 'Merge branch ' ELSE 'Docs for ' END, CAST(o_orderkey AS STRING)) AS message
        FROM {orders}""",
    "numstat": """
        SELECT concat('R', CAST(l_orderkey % 4 AS STRING)) AS repo, lpad(CAST(l_orderkey AS STRING), 40, '0') AS hash,
               concat('src/P', CAST(l_partkey AS STRING), '.sol') AS path,
               CAST(l_quantity AS BIGINT) AS insertions, CAST(round(l_discount * 100) AS BIGINT) AS deletions
        FROM {lineitem}""",
    "blame": """
        SELECT 'main' AS repo, concat('src/P', CAST(l_partkey AS STRING), '.sol') AS path,
               CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS INT) AS line,
               concat('dev_', CAST(o_custkey AS STRING)) AS author, o_orderdate AS author_time
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "long_blame": """
        SELECT 'main' AS repo, concat('Flag', l_returnflag, l_linestatus, '.sol') AS path,
               CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS line,
               concat('dev_', CAST(o_custkey AS STRING)) AS author, o_orderdate AS author_time
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "edges": """
        SELECT 'main' AS repo, concat('P', CAST(l_partkey AS STRING)) AS source, concat('S', CAST(l_suppkey AS STRING)) AS target, 'calls' AS edge_type, 1 AS weight
        FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem}) x
        UNION ALL SELECT 'main', concat('S', CAST(s_suppkey AS STRING)), concat('N', CAST(s_nationkey AS STRING)), 'inherits', 3 FROM {supplier}
        UNION ALL SELECT 'main', concat('N', CAST(n_nationkey AS STRING)), concat('G', CAST(n_regionkey AS STRING)), 'uses', 2 FROM {nation}""",
    "calls": """
        SELECT 'main' AS repo, concat('P', CAST(a AS STRING)) AS src, concat('P', CAST(b AS STRING)) AS dst, max(CASE WHEN s <> t THEN 1 ELSE 0 END) = 1 AS is_external
        FROM (SELECT l_partkey AS a, l_suppkey AS s,
                     lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS b,
                     lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS t
              FROM {lineitem}) x
        WHERE b IS NOT NULL GROUP BY a, b""",
    "docs": """
        SELECT 'main' AS repo, concat(source, CASE WHEN doc_id % 7 = 0 THEN '/lib/' ELSE '/' END, CAST(doc_id AS STRING), '.sol') AS path, text AS content, doc_id
        FROM {documents}""",
    "verdicts": """
        SELECT concat('E', CAST(l.doc_id AS STRING)) AS key, l.quality = 1 AS is_true_positive, concat('reason ', CAST(l.doc_id AS STRING)) AS reason, CAST(l.doc_id % 3 AS INT) AS batch
        FROM {labels} l""",
}

#: The findings that the analyzer reports of :func:`reports` hold, by arithmetic; only the oracle reads this.
FINDINGS_SQL = f"""
        SELECT 'main' AS repo, concat('E', CAST(event_id AS STRING)) AS key, sha256(concat('E', CAST(event_id AS STRING))) AS id, event_id, {_CHECK} AS check_type,
               CASE event_type WHEN 'click' THEN 'high' WHEN 'error' THEN 'medium' WHEN 'purchase' THEN 'low' WHEN 'signup' THEN 'informational' ELSE 'optimization' END AS severity,
               CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
               concat('S', CAST(user_id AS STRING)) AS contract, CASE WHEN event_id % 10 = 9 THEN 'setV' ELSE concat('f', CAST(event_id % 10 AS STRING)) END AS function,
               CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 5 = 0 THEN concat('S', CAST(user_id AS STRING), '.sol') ELSE concat('src/S', CAST(user_id AS STRING), '.sol') END AS file,
               CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 50 + 1 AS INT) END AS line_start, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 50 + 3 AS INT) END AS line_end,
               concat('Event ', CAST(event_id AS STRING), ' of type ', event_type) AS description
        FROM events WHERE event_id % 97 <> 0"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def commits(spark, sf_dir):
    return adapted(spark, sf_dir, "commits").withColumn("is_merge", F.col("message").contains("Merge"))


def log_records(spark, sf_dir):
    """repo, record: commits with their statistics as log text; the offset in the date is to be dropped."""
    stats = adapted(spark, sf_dir, "numstat").select("repo", "hash", F.concat_ws("\t", F.when(F.col("insertions") == 1, "-").otherwise(F.col("insertions").cast("string")), F.col("deletions").cast("string"), "path").alias("row"))
    listed = stats.groupBy("repo", "hash").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    date = F.concat(F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    lines = F.concat(F.array("hash", "short_hash", "author", date, "message"), F.coalesce("rows", F.array().cast("array<string>")))
    return commits(spark, sf_dir).join(listed, ["repo", "hash"], "left").select("repo", F.array_join(lines, "\n").alias("record"))


def reports(spark, sf_dir):
    """repo, key, report: one analyzer report per event, its contract only in a parent node."""
    e = table(spark, sf_dir, "events")
    s = lambda *x: F.concat(*(c.cast("string") if not isinstance(c, str) else F.lit(c) for c in x))
    user, i = F.col("user_id"), F.col("event_id")
    mapping = lambda lines: F.struct(
        F.when(i % 5 == 0, "").otherwise(s("src/S", user, ".sol")).alias("filename_relative"), s("S", user, ".sol").alias("filename_short"),
        s("/repo/src/S", user, ".sol").alias("filename_absolute"), lines.alias("lines"),
    )
    none = F.array().cast("array<int>")
    lines = F.when(i % 7 == 0, none).otherwise(F.transform(F.array(F.lit(2), F.lit(1), F.lit(3)), lambda x: (i % 50 + x).cast("int")))
    parent = F.struct(F.lit("contract").alias("type"), s("S", user).alias("name"), mapping(none).alias("source_mapping"))
    node = F.struct(
        F.lit("function").alias("type"), F.when(i % 10 == 9, "setV").otherwise(s("f", i % 10)).alias("name"), mapping(lines).alias("source_mapping"), F.struct(parent.alias("parent")).alias("type_specific_fields"),
    )
    impact = F.expr("CASE event_type WHEN 'click' THEN 'High' WHEN 'error' THEN 'Medium' WHEN 'purchase' THEN 'Low' WHEN 'signup' THEN 'Informational' ELSE 'Optimization' END")
    detector = F.struct(
        F.expr(_CHECK).alias("check"), impact.alias("impact"), F.expr("CASE event_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END").alias("confidence"),
        s("\n Event ", i, " of type ", F.col("event_type"), "\n").alias("description"), F.array(node).alias("elements"),
    )
    report = F.to_json(F.struct((i % 97 != 0).alias("success"), F.struct(F.array(detector).alias("detectors")).alias("results")))
    return e.select(F.lit("main").alias("repo"), s("E", i).alias("key"), report.alias("report"))


def sources(spark, sf_dir):
    """repo, path, content: a contract per supplier and one per nation. Facts follow from keys: see FACTS in queries."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nk")).join(F.broadcast(n))
    function = """
        concat('    function ', IF(j = 9, 'setV', concat('f', j)), '(S', (3 * k + j) % n, ' p', j, ', uint256 x)',
               element_at(array(' external', ' public', ' internal', ' private', ''), CAST((k + j) % 5 + 1 AS INT)),
               element_at(array(' view', ' pure', ' payable', ''), CAST((k + j) % 4 + 1 AS INT)),
               IF(j % 3 = 0, ' onlyOwner', ''), IF(j % 2 = 0, ' returns (uint256)', ''), ' {{\\n',
               '        v', j, ' = v', (j + 1) % 10, ' + x;\\n', '        f', (j + 2) % 9, '();\\n',
               '        t', j % 3, '.f', j, '(x);\\n', '        p', j, '.f', (j + 1) % 9, '(x);\\n', '    }}\\n')"""
    content = f"""
        concat('pragma solidity ^0.8.', k % 20, ';\\n', 'contract S', k, ' is N', nk, ' {{\\n', '    using L', k % 3, ' for uint256;\\n',
               '    event E', k, '(address a);\\n', '    error X', k, '(address a);\\n', '    modifier m', k % 5, '() {{ _; }}\\n',
               '    S', (7 * k) % n, ' public t0;\\n', '    mapping(address => S', (7 * k + 1) % n, ') public t1;\\n',
               array_join(transform(sequence(0, 9), j -> concat('    uint256 v', j, ';\\n')), ''),
               array_join(transform(sequence(0, 9), j -> {function}), ''), '}}')""".replace("{{", "{").replace("}}", "}")
    nation = """concat(element_at(array('abstract contract', 'interface', 'library', 'contract'), CAST(nk % 4 + 1 AS INT)), ' N', nk, ' {\\n',
               '    function g', nk, '(uint256 y) public {\\n', '        w = y;\\n', '    }\\n', '}')"""
    a = sup.select(F.lit("main").alias("repo"), F.expr("concat('src/S', k, '.sol')").alias("path"), F.expr(content).alias("content"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk")).select(F.lit("main").alias("repo"), F.expr("concat('src/N', nk, '.sol')").alias("path"), F.expr(nation).alias("content"))
    return shuffled(a.unionByName(b))  # texts of some kilobytes from rows of some bytes


def replies(spark, sf_dir):
    """key, raw: conversation turns as replies: fenced JSON, prose around JSON, or bare text."""
    c = table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("E"), F.col("conv_id").cast("string")).alias("finding_id"), (F.col("turn") % 2 == 0).alias("is_true_positive"), F.concat(F.lit("turn {"), F.col("turn").cast("string"), F.lit("}")).alias("reason"))).alias("results")))
    kind = (F.col("conv_id") + F.col("turn")) % 3
    raw = F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone."))).when(kind == 1, F.concat(F.lit("I think "), body, F.lit(" is right."))).otherwise(F.concat(F.lit("  no json "), F.col("conv_id").cast("string"), F.lit(" ")))
    return c.select("conv_id", "turn", raw.alias("raw"))
