import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from airmon.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = build_session("airmon-tests", "local[8]", 8, **{"spark.checkpoint.dir": f"file://{shared}"})
    s.sparkContext.setLogLevel("ERROR")
    # plans are checked as text, so nothing may be shortened
    s.conf.set("spark.sql.maxMetadataStringLength", "100000")
    s.conf.set("spark.sql.debug.maxToStringFields", "1000")
    yield s
    s.stop()
