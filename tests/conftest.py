"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from auditloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folders = {"spark.checkpoint.dir": tmp_path_factory.mktemp("shared"), "spark.sql.warehouse.dir": tmp_path_factory.mktemp("warehouse")}
    session = local_session(4, 4, "4g", **{k: f"file://{v}" for k, v in folders.items()})
    ship_package(session)
    yield session
    session.stop()
