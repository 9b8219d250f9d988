import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

import helpers  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(helpers.odd_rows(), helpers.SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], helpers.SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
