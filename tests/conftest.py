import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cinestat.session import local_session
    s = local_session("*", app="cinestat-tests", shuffle_partitions=8)
    yield s
    s.stop()
