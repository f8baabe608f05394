from __future__ import annotations

import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent)]


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    session = local_session("8", 4, "6g")
    yield session
    session.stop()
