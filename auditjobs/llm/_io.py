"""Tables, scratch tables in the cluster's shared folder, and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 300_000
#: The setting for the bytes of a batch between Spark and a Python worker, which counts rows of any length, and its value here.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of our own that is set there.

    Only a local master gets a folder of this machine; a cluster without the
    setting uses its warehouse, which all executors share.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if sc.master.startswith("local[") or sc.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Written intermediate tables: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/auditjobs-{uuid.uuid4().hex}"
        self.n = 0
        self.tables: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and read it again."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all written tables but these."""
        self.drop(*(t for t in self.tables if not any(t is k for k in tables)))

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.tables = [t for t in self.tables if not any(t is x for x in tables)]


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``rows`` rows; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def broadcast_if_light(df: DataFrame, column: str, rows: int = BROADCAST_ROWS, size: int = 48 << 20) -> DataFrame:
    """The same for rows whose size is mostly in one binary column, with a bound on its bytes too."""
    held = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(column)), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if held["n"] <= rows and held["size"] <= size else df


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names, so extra columns never clash.

    Where the session leaves the bytes of a batch at Spark's 64 MB, they are set to BATCH_BYTES: both sides of a task hold several.
    """
    if df.sparkSession.conf.get(BATCH_SETTING).rstrip("b") == str(64 << 20):
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def _plain_scan(df: DataFrame) -> bool:
    """Whether each row of df is a row of one table of files, picked and filtered at most."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation")


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """df with a distinct long for each row that is the same in every job, however a scan is split.

    For Parquet it is the file's place among the files by name, and the row's in the file; any other
    df is written with numbers once and read again.
    """
    if _plain_scan(df):
        try:
            files = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())
            numbers = df.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], "_file string, _first long")
            rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
            return rows.join(F.broadcast(numbers), "_file").select(*(rows[f"`{c}`"] for c in df.columns), (F.col("_first") + F.col("_place")).alias(name))
        except AnalysisException:
            pass
    return Scratch(df.sparkSession).cut(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
