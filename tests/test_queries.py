"""Every core query runs, and agrees with its SQL where it has one."""

import os

import pytest

from termloom.plans import registry
from tests.compare import SMALL, assert_same, connect

QUERIES, ORACLES = registry.queries(), registry.oracles()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert_same(spark, con, QUERIES[name], ORACLES[name])
    else:
        QUERIES[name](spark, SMALL).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
