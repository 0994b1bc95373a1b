import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from rentwise.session import build_session  # noqa: E402
from rentwise.sources.seed import seed_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app_name="rentwise-tests", extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    return seed_tables(spark)


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
