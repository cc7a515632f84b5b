"""Every query with an SQL twin gives the twin's rows, on whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_parity import compare, connect

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert compare(df.toPandas(), duck.execute(SQL[name]).df()) is None


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["repeat", "fold", "roc_auc"]
    assert df.count() == 5
