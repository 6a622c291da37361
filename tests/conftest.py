import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from brieflens.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[4]", 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
