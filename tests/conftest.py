from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cellhealth.schemas import FEATURES, TELEMETRY_SCHEMA
from cellhealth.session import local_session

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "tests", 4, **{"spark.ui.showConsoleProgress": "false", "spark.python.unix.domain.socket.enabled": "true"}
    )
    yield session
    session.stop()


START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def event(number: int, seconds: float = 0, cell: str | None = "CELL_0001", region: str | None = "North", **metrics):
    """One telemetry row; metrics not given hold harmless values."""
    calm = dict(zip(FEATURES, (-50.0, 100.0, 20.0, 0.5, 0.5, 2.0)))
    values = {**calm, **metrics}
    return (number, at(seconds), cell, region, *[values[m] for m in FEATURES])


@pytest.fixture(scope="session")
def telemetry(spark):
    def make(rows):
        return spark.createDataFrame(rows, TELEMETRY_SCHEMA)

    return make
