import pytest

from collatrix.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, app="collatrix-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
