import pytest

from actloom.core.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
