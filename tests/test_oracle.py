"""Every catalog query against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, connection, name):
    problem, _ = compare(spark, connection, SF, entry.queries()[name], ORACLES[name])
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
