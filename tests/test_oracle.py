"""Every registered query against its DuckDB text on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    assert compare(spark, duck, name, queries()[name], oracle_sql()[name], SF_DIR) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
