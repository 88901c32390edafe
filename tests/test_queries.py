"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from inversia.queries import REGISTRY
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CHECKED = contract.oracle_sql()
# the optional package brings tests of its own
OWN = set(REGISTRY)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in contract.queries() if n in OWN])
def test_query(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    assert difference(df, con, CHECKED[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "start_time" in df.columns
