import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quillon.session import build_session
    s = build_session("local[*]", app="quillon-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(s.conf.get("spark.checkpoint.dir", None)
                                        or tempfile.mkdtemp(prefix="quillon-test-ckpt-"))
    yield s
