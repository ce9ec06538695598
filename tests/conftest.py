import pytest

from argentum.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="2g", partitions=4)
    yield session
    session.stop()
