from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loadweave.session import ensure_checkpoint_dir, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 8)
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


@pytest.fixture()
def series(spark):
    """Build a (datetime_15min, value...) frame from text stamps."""

    def build(rows, columns="datetime_15min timestamp_ntz, v double"):
        parsed = [tuple(datetime.fromisoformat(c) if isinstance(c, str) and c[:2] == "20" and "T" in c else c for c in r) for r in rows]
        return spark.createDataFrame(parsed, columns)

    return build
