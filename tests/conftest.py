import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from termloom.session import find_package, local_session

    s = local_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    find_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a DataFrame with expected tuples, in any order."""

    def check(df, rows):
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)

    return check
