from __future__ import annotations

import os
import struct
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from larkspan.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    s = build_session(master="local[4]", app="tests", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def as_float32(x):
    return struct.unpack("<f", struct.pack("<f", x))[0] if isinstance(x, float) else x


def assert_rows(got: list[dict], wanted: list[dict]) -> None:
    """Equal but for the order of rows and digits beyond 32-bit floats; names and types count."""
    norm = lambda rows: sorted(([(k, type(v).__name__, as_float32(v)) for k, v in sorted(r.items())] for r in rows), key=repr)
    assert norm(got) == norm(wanted)
