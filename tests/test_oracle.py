"""Every registered query of the audit engine against its SQL in DuckDB."""

import pytest
from compare import connected, rows

from tracequill.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    return connected(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
