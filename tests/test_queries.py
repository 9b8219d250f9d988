"""Every registered query of the library's own against its SQL counterpart."""

import pytest
from compare import compare, duck

import __spark_entry__ as contract
from logweave.plans.oracles import ORACLES
from logweave.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(ORACLES) == set(QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    assert compare(spark, connection, name, QUERIES[name], ORACLES[name], SF_DIR) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
