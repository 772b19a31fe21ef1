import pytest

from tilespark import queries

from .oracle import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, con, name):
    compare(spark, con, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64 * 64
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
