from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from crewledger.session import build_session, use_checkpoints  # noqa: E402
from tests.fixture import make_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__sql__maxMetadataStringLength="4000", spark__sql__session__timeZone="UTC", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    use_checkpoints(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return make_tables(spark)
