"""One local session for all tests."""

from __future__ import annotations

import pytest

from postmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g", "postmill-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
