import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_queries import session  # noqa: E402
from kgspark.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = tune(session("8"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
