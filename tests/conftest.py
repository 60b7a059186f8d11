import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trackspark.session import get_session

# Test modules build windows at import time, which needs a running session.
SESSION = get_session("local[8]", "tests", 4)


@pytest.fixture(scope="session")
def spark():
    return SESSION
