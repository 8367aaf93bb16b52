"""Every checked query against the SQL oracle on the smallest tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from hazardflow.checks import load

QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.fixture(scope="module")
def oracle(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, small, oracle, name):
    assert differences(QUERIES[name](spark, small), oracle, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    found = QUERIES[name](spark, small)
    assert found.columns and found.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
