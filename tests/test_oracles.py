"""Every registered query against its DuckDB form, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from marketlens.plans import catalog
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_match():
    assert set(ORACLES) <= set(QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "competitor_id" and df.count() > 0
