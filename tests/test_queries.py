"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as entry
from check import connect, difference
from tidemark.queries import load

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "event_type", "ts", "new_ts"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert difference(QUERIES[name](spark, SF_DIR), ORACLES[name], con) is None
