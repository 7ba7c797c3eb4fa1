import pytest

from obscat.operators import fold as fo
from obscat.plans.fold_queries import obs
from obscat.plans.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def exchanges(df):
    """Names of the columns that each shuffle of a plan moves."""
    out, left = [], [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        left += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "RepartitionByExpression":
            out.append({node.output().apply(i).name() for i in range(node.output().size())})
    return out


def test_a_fold_moves_only_what_is_read(spark):
    found = exchanges(fo.fold(obs(spark, SF_DIR), pack="hashes").select("entity_hash"))
    assert found == [{"source", "source_key", "arrival_key", "fetched_at", "entity_hash"}]


@pytest.mark.parametrize("pack", ["rows", "hashes"])
def test_packed_folds_give_the_same_rows(spark, many_slices, pack):
    log = obs(spark, SF_DIR)
    plain, packed = (fo.fold(log, pack=p) for p in (None, pack))
    assert plain.dtypes == packed.dtypes and plain.exceptAll(packed).isEmpty() and packed.exceptAll(plain).isEmpty()
    plain, packed = (fo.mark_late(log, pack=p) for p in (None, pack))
    assert plain.exceptAll(packed).isEmpty() and packed.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("name", ["cascade_delete", "backfill_insert_ignore", "backfill_links"])
def test_no_link_is_moved_that_is_not_read(spark, name):
    moved = exchanges(QUERIES[name](spark, SF_DIR))
    assert len(moved) >= 3 and sum("link" in m for m in moved) <= (name == "backfill_insert_ignore")
