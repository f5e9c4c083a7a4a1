"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from coord.plans import load

NAMES = list(oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    got = queries()[name](spark, sf).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert compare(got, want) is None


def test_every_query_of_the_library_has_sql():
    assert set(load().QUERIES) == set(load().ORACLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
