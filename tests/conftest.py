import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from obscat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def many_slices(spark, monkeypatch):
    """Cut every key with more than one row, and shuffle to more tasks."""
    from obscat.operators import skew

    monkeypatch.setattr(skew, "HEAVY_ROWS", 1)
    monkeypatch.setattr(skew, "MOST_HEAVY", 5_000)
    monkeypatch.setattr(skew, "SLICES", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
