import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from creditloom.session import build_session

    root = tmp_path_factory.mktemp("spark")
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__sql__warehouse__dir=str(root / "warehouse"),
        spark__checkpoint__dir=str(root / "scratch"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""
    def collect(df):
        return sorted((tuple(r) for r in df.collect()),
                      key=lambda t: tuple((v is not None, str(v)) for v in t))
    return collect


@pytest.fixture
def one():
    """The only row of a frame as a dict."""
    def first(df):
        found = df.collect()
        assert len(found) == 1
        return found[0].asDict()
    return first
