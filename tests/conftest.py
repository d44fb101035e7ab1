import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from attestry.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
