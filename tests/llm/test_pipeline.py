import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from obscat.llm import bpe
from obscat.llm.store import written
from tests.llm import plain

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), f"test-{name}")
        out.append(docs.toPandas())
    return out


def test_columns_stay_until_the_last_stage(stages):
    for frame in stages[1:-1]:
        assert list(frame.columns) == list(stages[0].columns)
    assert list(stages[-1].columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_stage_drops_labelled_junk(spark, stages):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    left = set(stages[1].doc_id)
    junk = set(labels[labels.quality == 0].doc_id)
    assert len(left & junk) <= 0.2 * len(junk) and set(left) <= set(stages[0].doc_id)
    assert stages[1].merge(stages[0], on=list(stages[0].columns)).shape[0] == len(stages[1])


def test_one_document_of_each_group_stays(stages):
    docs = list(zip(stages[1].doc_id, stages[1].text))
    want = plain.near_classes(docs, 5, 80)
    assert set(stages[2].doc_id) == {i for i, root in want.items() if i == root}


def test_documents_with_benchmark_items_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    docs = list(zip(stages[2].doc_id, stages[2].text))
    leaked = {d for d, _ in plain.best_windows(docs, items)}
    assert set(stages[3].doc_id) == {d for d, _ in docs} - leaked


def test_secrets_are_replaced(stages):
    before = dict(zip(stages[3].doc_id, stages[3].text))
    assert set(before) == set(stages[4].doc_id)
    for r in stages[4].itertuples():
        assert r.n_chars == len(r.text) and not [s for s in plain.secrets(r.text) if r.text[s[1] : s[2]] in before[r.doc_id]]
        if not plain.secrets(before[r.doc_id]) and "[secret]" not in r.text:
            assert r.text == before[r.doc_id]


def test_tokens_of_what_is_left(stages):
    with open(bpe.vocabulary_path(), encoding="utf-8") as file:
        own = bpe.WordBpe(file.read())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in stages[5].itertuples()}
    want = {i: own.encode([t])[0][0] for i, t in zip(stages[4].doc_id, stages[4].text)}
    assert got == {i: (len(ids) // 4, hashlib.sha256(ids).hexdigest()) for i, ids in want.items()}


def test_run_is_all_stages(spark, stages):
    found = entry.queries()["pipeline"](spark, SF_DIR).toPandas()
    columns = list(found.columns)
    assert sorted(found.itertuples(index=False)) == sorted(stages[-1][columns].itertuples(index=False))


def test_rows_with_nulls_and_empty_table(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "a few good words in a text", "en", None, 3), (1, "a few good words in a text", "en", None, 3), (2, "", "en", "s", 0)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, written(docs, "in"), SF_DIR), f"test-{name}")
        assert docs.count() <= 1
