from __future__ import annotations

import pytest

from variscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="variscope-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
