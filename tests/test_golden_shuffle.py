"""Rows of items are shuffled once, with the columns that are read; heavy items are combined before the shuffle."""

import re

import pytest

from obscat.operators import skew
from obscat.operators.fold import fold, sparse
from obscat.operators.golden import golden_record
from tests.test_fold import frame, random_log

AS_OF = "2024-02-01 00:00:00"


def text(df):
    return sorted(str(r.asDict()) for r in df.select(*sorted(df.columns)).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [1_000_000, 40])
def test_light_and_heavy_items_give_the_same_rows(spark, monkeypatch, least):
    log = sparse(frame(spark, random_log(31, 200)))
    want = text(golden_record(fold(log), AS_OF))
    monkeypatch.setattr(skew, "HEAVY_ROWS", least)
    assert text(golden_record(fold(log), AS_OF, log=log)) == want


def test_one_shuffle_of_the_columns_that_are_read(spark):
    log = sparse(frame(spark, random_log(32, 50)))
    gold = golden_record(fold(log), AS_OF, log=log).select("entity_hash", "popularity")
    found = plan(gold)
    assert found.count("Exchange hashpartitioning") == 2
    assert not re.search(r"\b(title|languages|quality)#", found.split("Scan")[0])
