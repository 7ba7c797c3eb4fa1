"""Rows that grow with the documents are never broadcast, whatever size Spark gives them."""

import re

import corpus_pipeline
from obscat.llm import decontam, dedup, quality
from obscat.llm.store import written

SF_DIR = "/root/testdata/sf0.001"
#: Model values of one character, a row per language, and rows of benchmark items.
BOUNDED = ("key", "lang", "item", "coalesce(lang")


def test_no_stage_broadcasts_rows_of_documents(spark, monkeypatch):
    plans = []

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *args)

    for module in (corpus_pipeline, quality, dedup, decontam):
        monkeypatch.setattr(module, "written", noted)
    # tasks hold few n-grams, so that the others are joined
    monkeypatch.setattr(quality, "HOT", 16)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = noted(stage(spark, docs, SF_DIR), f"test-{name}")
    keys = {k for plan in plans for k in re.findall(r"BroadcastHashJoin \[([\w(]+?)#", plan)}
    assert len(plans) > 20 and keys <= set(BOUNDED), keys
