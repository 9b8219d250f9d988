"""Queries that SQL can express, against DuckDB."""

import pytest
from compare import compare, duck

from logweave.llm.oracles import ORACLES
from logweave.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    assert compare(spark, duck(sf), name, QUERIES[name], ORACLES[name], sf) == []


def test_all_operators():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14))
