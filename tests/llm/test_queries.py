import re

import pytest

import __spark_entry__ as entry
from obscat import llm

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in llm.QUERIES)
    assert numbers == list(range(1, 11)) and set(llm.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name, table, key", [
    ("op2_quality", "documents", "doc_id"), ("op3_bpe", "documents", "doc_id"), ("op4_langid", "documents", "doc_id"), ("op5_dedup", "documents", "doc_id"),
    ("op7_pii", "documents", "doc_id"), ("op8_warc", "pages", "page_id"), ("op9_licenses", "documents", "doc_id"), ("op10_secrets", "documents", "doc_id"),
])
def test_whole_tables_come_out(spark, name, table, key):
    found = [r[0] for r in entry.queries()[name](spark, SF_DIR).select(key).collect()]
    assert sorted(found) == sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).collect())
