import pytest

from rolecast.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, name="tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
