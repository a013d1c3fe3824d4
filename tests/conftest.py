import pytest

from stridelake.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = ship(local_session("tests", cores=4, shuffle_partitions=4))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
