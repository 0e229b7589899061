"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from dinesight.session import build_session
    session = build_session("tests", master="local[4]", **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
