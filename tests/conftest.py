import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from paigham.session import local_session, ship

    session = local_session(4, partitions=4, memory="4g", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not Path(folder).exists():
        pytest.skip("no test tables")
    return folder


@pytest.fixture()
def messages(spark):
    """A message table with the dirt operators must bear, and columns whose names could clash."""

    def make(rows, split=None):
        full = [(i, m, s, src, "x", 1, "y") for i, (m, s, src) in enumerate(rows, 1)]
        return spark.createDataFrame(full, "row_id bigint, msg string, status string, source string, _key string, n int, h string")

    return make
