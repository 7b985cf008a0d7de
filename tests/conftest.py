import os

import pytest

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    return local_session(8, partitions=8, memory="6g", name="tests")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
