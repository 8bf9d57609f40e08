import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wiretally.session import local_session  # noqa: E402
from wiretally.streaming.limits import use_keyed_state  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    use_keyed_state(session)
    yield session
    session.stop()
