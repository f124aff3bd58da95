import pytest

from gleaner.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("warehouse")
    session = get_session("tests", cpus="4", spark__sql__warehouse__dir=str(home), spark__sql__shuffle__partitions="4")
    yield session
    session.stop()
