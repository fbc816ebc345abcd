import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cardsight.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cardsight-test-ckpt-"))
    yield s
    s.stop()
