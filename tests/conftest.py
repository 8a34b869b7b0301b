import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from waymark.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, "waymark-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
