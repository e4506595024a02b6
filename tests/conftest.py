import os

import pytest

from tidemill.session import get_session, ship

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_session("8", app="tests", spark__driver__memory="6g", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL
