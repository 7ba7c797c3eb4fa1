"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from obscat.sources.views import TABLES
from tools.check import rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def oracle_rows(duck, name):
    return duck.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toArrow().to_pandas()
    if name not in entry.oracle_sql():
        return
    want = oracle_rows(duck, name)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


SLICED = [
    "late_rejected", "obs_fold", "details_retention", "relink_report", "rank_observations",
    "fact_suffix", "golden_record", "orphan_items", "sort_modes", "popularity_order",
]


@pytest.mark.parametrize("name", SLICED)
def test_many_slices_give_the_same_result(spark, duck, many_slices, name):
    got = entry.queries()[name](spark, SF_DIR).toArrow().to_pandas()
    assert rows(got) == rows(oracle_rows(duck, name))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
