"""Every registered query against its SQL twin, and the entry points."""

import pytest

import __spark_entry__ as entry_points
from parity.check import compare, connect
from parity.oracle import oracle_sql
from waymark.plans.registry import queries

NO_TWIN: set[str] = set()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_a_twin():
    assert set(queries()) - set(oracle_sql()) == NO_TWIN
    assert not set(oracle_sql()) - set(queries())


@pytest.mark.parametrize("name", sorted(set(queries()) - NO_TWIN))
def test_equal_to_sql(spark, con, small, name):
    assert compare(spark, con, small, name) is None


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.columns[0] == "business_id" and found.count() > 0
