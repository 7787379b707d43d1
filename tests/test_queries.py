"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_module.QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) is None


def test_entry(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["primary_theme", "priority", "n"]
    assert got.count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(entry_module.QUERIES) <= set(entry_module.oracle_sql())
