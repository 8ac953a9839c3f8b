import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from meterlens.session import local_session

    session = local_session(4, shuffle_partitions=4, app="meterlens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from fixtures.views import Tables

    return Tables(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    from check import connect

    return connect(SF_DIR)


@pytest.fixture
def frame(spark):
    """A small DataFrame from rows and a DDL schema."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)
