"""Every query with SQL gives what a SQL engine gives."""

import pytest

import oracle
from tessera.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {n for n in QUERIES if n not in ORACLES}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert oracle.differences(spark, con, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
