import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oddledger.session import GROUP_ROWS_CONF, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Every key above 40 rows counts as hot, so that the split paths run."""
    spark.conf.set(GROUP_ROWS_CONF, "40")
    yield 40
    spark.conf.unset(GROUP_ROWS_CONF)
