import pytest

import __spark_entry__ as driver
from assayer.catalog.registry import REGISTRY
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = {name: q.run for name, q in REGISTRY.items()}
SQL = {name: q.sql for name, q in REGISTRY.items() if q.sql}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    df = driver.entry(spark)
    assert "confidence" in df.columns and df.count() > 0
