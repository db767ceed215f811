import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from outcry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("outcry-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("OFF")
    if not session.sparkContext.getConf().get("spark.checkpoint.dir"):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="outcry-tests-"))
    yield session
    session.stop()
