import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracemill.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cores=4, shuffle=4)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
