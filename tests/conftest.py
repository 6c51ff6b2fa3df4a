import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signalspark.layout import TASK_ROWS_SETTING  # noqa: E402
from signalspark.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def cut_series(spark):
    """Every ordered group longer than 20 rows is cut."""
    spark.conf.set(TASK_ROWS_SETTING, "20")
    yield
    spark.conf.unset(TASK_ROWS_SETTING)


@pytest.fixture(scope="session")
def sf():
    return SF_DIR
