import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lociq.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4, 4, "2g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def pytest_collection_modifyitems(items):
    """The graph's own tests first: tests of an optional subpackage come last."""
    items.sort(key=lambda i: Path(__file__).parent != i.path.parent)
