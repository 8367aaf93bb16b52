from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from hazardflow import session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    built = session.build(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.log.level": "ERROR",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    yield built
    built.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
