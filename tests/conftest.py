from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("BENCH_DRIVER_MEMORY", "4g")
    from tracelode.session import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    folder = Path(os.environ.get("TEST_DATA", "/root/testdata/sf0.001"))
    if not folder.exists():
        pytest.skip("no test data here")
    return str(folder)
