"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as contract
from apilens.plans import oracles, registry
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, connection, name):
    found = differences(spark, connection, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert not found, found


def test_entry(spark):
    assert contract.entry(spark).count() > 0
