import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wardlake.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "wardlake-tests", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as plain tuples, sorted."""

    def collect(df, *cols):
        picked = df.select(*cols) if cols else df
        order = lambda r: tuple((x is None, x if isinstance(x, (int, float, str)) else str(x)) for x in r)
        return sorted((tuple(r) for r in picked.collect()), key=order)

    return collect
