"""One local session for all tests."""

import pytest

from mnemoframe.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores=4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session
