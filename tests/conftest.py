"""One local session for all tests; checkpoints go to a temporary folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, **{"spark.default.parallelism": "4", "spark.sql.files.maxPartitionBytes": "1m"})
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def data():
    return os.environ.get("WEFTLINE_DATA", "/root/testdata") + "/sf0.001"
