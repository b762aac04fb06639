"""Every query of the subpackage runs, and agrees with its SQL where it has one."""

import os

import pytest

from termloom.llm.oracles import ORACLES
from termloom.llm.queries import QUERIES
from tests.compare import SMALL, assert_same, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert_same(spark, connect(), QUERIES[name], ORACLES[name])
    else:
        QUERIES[name](spark, SMALL).collect()
