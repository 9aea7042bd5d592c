import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postmill.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("tests", "local[4]", {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def plan():
    """The physical plan of a frame as text."""
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()
    return text
