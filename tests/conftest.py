import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidewater.session import build_session
    s = build_session("local[4]", 4, app_name="tidewater-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tw-test-ckpt-"),
                             "spark.driver.memory": "4g"})
    yield s
    s.stop()
