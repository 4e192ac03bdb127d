import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from locusmill.session import get_spark, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = ship(get_spark("tests", 4, 4))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
