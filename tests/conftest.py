import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = os.environ.get("BIZLENS_TEST_SF", "/root/testdata/sf0.001")
SF_ORACLE = os.environ.get("BIZLENS_ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from bizlens.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, driver_memory="8g", app="bizlens-tests")
    yield s
    s.stop()
