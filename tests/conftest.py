import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from mediaseries.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", "tests", 4)
