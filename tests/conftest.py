import pytest

from inversia.session import build_session, clear_run


@pytest.fixture(scope="session")
def spark():
    session = build_session("inversia-tests", cores="8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_run(session)
    session.stop()
