"""Model replies: JSON, fenced code, verdicts, submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import first_json_object

#: Leads a submission.
SUBMISSION_PREFIX = "__SUBMIT_TRUE_POSITIVES__"
_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
_BLANK = " \n\t\r"


def extract_json_reply(replies: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds json: a fenced block's content, else the first balanced {...}, else the text."""
    raw = F.trim(F.coalesce(F.col(raw_col), F.lit("")), F.lit(_BLANK))
    fenced = F.when(raw.rlike(_FENCE), F.trim(F.regexp_extract(raw, _FENCE, 1), F.lit(_BLANK)))
    plain = replies.withColumn("_raw", raw).withColumn("_fenced", fenced)
    return plain.withColumn("json", F.coalesce("_fenced", first_json_object("_raw"), "_raw")).drop("_raw", "_fenced")


def extract_fenced_code(replies: DataFrame, lang: str = "solidity", raw_col: str = "raw") -> DataFrame:
    """Adds code: the first block fenced with the language or without, trimmed, else ''."""
    pattern = r"(?s)```(?:\Q" + lang + r"\E)?\s*\n(.*?)```"
    return replies.withColumn("code", F.trim(F.regexp_extract(F.coalesce(F.col(raw_col), F.lit("")), pattern, 1), F.lit(_BLANK)))


def parse_verdict_replies(replies: DataFrame, keys: list[str], json_col: str = "json") -> DataFrame:
    """finding_id, is_true_positive, reason of each entry of ``results``; missing values are '' and false. Broken JSON gives nothing."""
    kind = "struct<results: array<struct<finding_id: string, is_true_positive: boolean, reason: string>>>"
    rows = replies.select(*keys, F.inline(F.from_json(json_col, kind)["results"]))
    return rows.select(*keys, F.coalesce("finding_id", F.lit("")).alias("finding_id"), F.coalesce("is_true_positive", F.lit(False)).alias("is_true_positive"), F.coalesce("reason", F.lit("")).alias("reason"))


def parse_submissions(replies: DataFrame, keys: list[str], raw_col: str = "raw") -> DataFrame:
    """keys, finding_id, confirmed, reason, exploit_scenario of prefixed payloads: one row per id that is named anywhere in it. Bad JSON gives nothing."""
    kind = "struct<finding_ids: array<string>, reasons: map<string, string>, exploit_scenarios: map<string, string>>"
    payload = F.from_json(F.trim(F.expr(f"substring({raw_col}, {len(SUBMISSION_PREFIX) + 1})")), kind)
    rows = replies.filter(F.col(raw_col).startswith(SUBMISSION_PREFIX)).select(*keys, payload.alias("p"))
    none, empty = F.array().cast("array<string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = rows.select(*keys, F.coalesce("p.finding_ids", none).alias("ids"), F.coalesce("p.reasons", empty).alias("reasons"), F.coalesce("p.exploit_scenarios", empty).alias("scenarios"))
    named = F.array_distinct(F.concat("ids", F.map_keys("reasons"), F.map_keys("scenarios")))
    rows = rows.select(*keys, "ids", "reasons", "scenarios", F.explode(named).alias("finding_id"))
    return rows.select(*keys, "finding_id", F.array_contains("ids", F.col("finding_id")).alias("confirmed"), F.col("reasons")[F.col("finding_id")].alias("reason"), F.col("scenarios")[F.col("finding_id")].alias("exploit_scenario"))
