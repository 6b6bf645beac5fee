import pytest

from strataflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    made = build_session(4)
    yield made
    made.stop()
