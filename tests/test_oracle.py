"""Every registered query against its SQL."""

import os

import pytest
from oracle import compare, connect

from tidewatch.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problems = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    # The smallest tables may leave a rare condition without rows.
    assert [p for p in problems if "tests nothing" not in p] == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["period_start", "previous_state", "state"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
