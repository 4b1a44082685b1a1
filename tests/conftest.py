import pytest

from corpusloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, shuffle_partitions=4, memory="4g", app="tests")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
