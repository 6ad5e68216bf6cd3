import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from surgelens.session import local_session
    return local_session("surgelens-tests", "4", "8g")


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(tiny):
    from tests.check_oracle import duck
    return duck(tiny)
