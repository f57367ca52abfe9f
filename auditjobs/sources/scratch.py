"""Cutting lineage in iterated jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without the setting gets one of its own. A cluster must name one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read from there: what reads it takes only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose next join shuffles or sorts both sides: sizes of files that compress well, or of what is parsed from small rows, mislead a broadcast."""
    return df.hint("merge")
