import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from ebbline.session import local_session

    return local_session(8, shuffle_partitions=8)


@pytest.fixture(scope="session")
def subs(spark):
    from ebbline.sources import bridge

    frame = bridge.subscribers(spark, SMALL).persist()
    yield frame
    frame.unpersist()
