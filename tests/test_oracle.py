"""Every query with SQL gives the same rows, names, types and values in DuckDB."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

ORACLE = oracle_sql()


@pytest.fixture(scope="session")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, folder, name):
    assert difference(queries()[name](spark, folder), con, ORACLE[name]) is None


def test_all_sql_belongs_to_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["rfm_segment", "customers", "avg_monetary"]
    assert df.count() > 0
