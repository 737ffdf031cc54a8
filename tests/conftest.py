import pytest

from tessella.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cpus=8, shuffle=4)


@pytest.fixture(scope="session")
def sf():
    return SF
