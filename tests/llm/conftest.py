import pytest

from signalspark.session import local_session


@pytest.fixture(scope="session")
def texts_spark():
    """Shared with the other tests' session where that is running; it stays open for them."""
    return local_session(8, shuffle_partitions=4, app="tests")
