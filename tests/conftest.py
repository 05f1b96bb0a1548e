import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from wattloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture()
def split_everything(spark):
    """Every series counts as too large for one task."""
    spark.conf.set("wattloom.split.bytes", "0")
    spark.conf.set("wattloom.split.rows", "20")
    yield
    spark.conf.unset("wattloom.split.bytes")
    spark.conf.unset("wattloom.split.rows")
