"""Every registered query against its SQL."""

import pytest

from auditjobs.jobs import queries


def test_each_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(same_rows, name):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
