import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("LEAFMILL_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from leafmill.session import local_session

    return local_session("tests")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def con(sf):
    import oracle

    return oracle.connect(sf)
