"""Every query that SQL can express against that SQL."""

import pytest
from compare import DIR, assert_same

from siltstone.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    got = QUERIES[name](spark, DIR)
    assert got.columns and got.limit(1).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
