import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from dumptables.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folders = {"spark.checkpoint.dir": tempfile.mkdtemp(), "spark.sql.warehouse.dir": tempfile.mkdtemp()}
    session = build_session("tests", "8", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}, **folders)
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def set_option(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_option
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
