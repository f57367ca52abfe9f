import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Compare a query with its SQL as bags of rows with equal column names."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    def check(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        result = duck.execute(sql)
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        expected = sorted(repr([plain(row[i]) for i in at]) for row in result.fetchall())
        assert sorted(repr([plain(v) for v in row]) for row in df.select(columns).collect()) == expected

    return check
