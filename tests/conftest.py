from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = build_session("local[4]", shuffle_partitions=4, **{"spark.sql.warehouse.dir": str(warehouse), "spark.driver.memory": "4g"})
    yield session
    session.stop()
