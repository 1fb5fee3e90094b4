import pytest

from lumenquote.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, memory="3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
