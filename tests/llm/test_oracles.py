"""Registered queries against their SQL."""

import pytest

from clickspan.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    difference, _, _ = compare(spark, duck, QUERIES[name], ORACLES[name], sf_dir)
    assert difference is None


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert all(query.__name__ == name for name, query in QUERIES.items())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
