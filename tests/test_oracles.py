"""Every registered query against its oracle, and the driver's contract."""

import pytest

import __spark_entry__ as contract
from clickspan.catalogue import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    difference, _, _ = compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert difference is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_names():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())
    assert set(ORACLES) <= set(QUERIES)
    assert all(q.__name__ == name for name, q in QUERIES.items())
