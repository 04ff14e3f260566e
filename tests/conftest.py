import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("SLUICEBOX_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sluicebox.session import local_session

    s = local_session(4, "4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    return SF


def rows(df):
    """The rows of a small result as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
