import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from lexforge.session import local_session

    session = local_session(4, 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("LEXFORGE_TEST_DATA", "/root/testdata/sf0.001")
