from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from episodia.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4",
           "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
           "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny() -> str:
    return "/root/testdata/sf0.001"
