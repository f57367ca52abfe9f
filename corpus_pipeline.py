"""A training-data pipeline over documents: each stage filters or rewrites what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditjobs.llm import exact_dedup, ngram_join, packing, quality_crf, repeat_removal
from auditjobs.llm._io import Scratch, broadcast_if_small, numbered, table

#: A document stays if its quality score is at least this.
QUALITY_LEAST = 0.3
#: The row number under which a stage finds its rows again.
ROW = "_row_of_stage"


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(broadcast_if_small(kept), ROW, "left_semi").drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field over lines does not reject; every fifth id's label is held out from it."""
    may_learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    theta = quality_crf.train(docs, table(spark, sf_dir, "labels"), may_learn)
    scored = quality_crf.score(docs, theta, keep=tuple(docs.columns)).filter(F.col("score") >= QUALITY_LEAST)
    return scored.select(*(F.col(f"column{i}").alias(c) for i, c in enumerate(docs.columns)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    rows = numbered(docs, ROW)
    kept = exact_dedup.exact_dedup(rows, row_col=ROW).filter("kept").select(F.col("rid").alias(ROW))
    return _only(rows, kept)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles (five words, 0.8), that of the smallest id; texts without words stay."""
    rows = numbered(docs, ROW)
    kept = ngram_join.similar_components(rows, row_col=ROW).filter("first").select(F.col("rid").alias(ROW))
    return _only(rows, kept)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 100 bytes that start earlier too; n_chars follows the text."""
    cut = repeat_removal.remove_repeats(docs, keep=tuple(c for c in docs.columns if c != "text"))
    rest = iter(range(len(docs.columns)))
    columns = [F.col("kept_text").alias("text") if c == "text" else F.col(f"column{next(rest)}").alias(c) for c in docs.columns]
    out = cut.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids. Workers remember fewer words, since they serve the other stages too."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words_kept=150_000)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: No SQL expresses the learned and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each result written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.cut(docs, name.replace(" ", "-"))
    return docs
