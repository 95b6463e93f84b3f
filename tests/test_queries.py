"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from lakefold.plans import ORACLES, QUERIES

from .oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
