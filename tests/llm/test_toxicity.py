"""Subword embeddings: held-out labels, unseen misspellings, and a plain version of the scores."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from obscat.llm import toxicity

SF = "/root/testdata/sf0.1"
MILD = [a + b for a in ("river", "stone", "cloud", "field", "paper", "green", "light", "water") for b in ("", "ing", "er", "ly", "side", "s")]
RUDE = ["grobnik", "grobniker", "grobnikly", "vashtok", "vashtoks", "vashtoking"]


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(MILD) for _ in range(rng.randrange(15, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE[:-1] if seed else RUDE))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.createDataFrame(texts(1, 600), "id long, text string, toxic int"))


def plain_log_odds(text, by_bucket, weight, bias):
    """One word after another."""
    total, sum_ = 0.0, 0.0
    word, words = "", []
    for ch in text.lower() + " ":
        if ch.isdigit() and ord(ch) < 128 or "a" <= ch <= "z" or ord(ch) > 127:
            word += ch
        elif word:
            words.append(word)
            word = ""
    for word in words:
        row, _, data, starts, ends, hashes = toxicity._bag(pa.array([word]))
        w = float(weight[toxicity._slot(hashes)[0]])
        marked = f"<{word}>"
        values = []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                points = np.array([ord(c) for c in marked[i : i + n]], np.uint64)
                value = np.array([n], np.uint64)
                for p, r in zip(points, toxicity._ROUND):
                    value += p * r
                values.append(float(by_bucket[int(toxicity.mixed(value)[0] >> np.uint64(64 - toxicity.BITS))]))
        total += w
        sum_ += w * (sum(values) / max(len(values), 1))
    return (sum_ / total if total else 0.0) + bias


def test_scores_equal_a_plain_version(model):
    rows = [t for _, t, _ in texts(3, 12)] + [None, "", "  .,", "Grobnik! ÄÖ ü 😀 a", "x" * 5000, "GROBNIK grobnik"]
    got = toxicity.log_odds(pa.array(rows), *model)
    want = [plain_log_odds(t or "", *model) for t in rows]
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6)


def test_unseen_misspellings_share_vectors(model):
    calm = " ".join(MILD[:30])
    scores = toxicity.log_odds(pa.array([calm, calm + " grobnnik grobnikk vashtokking"]), *model)
    assert scores[0] < 0 < scores[1]


def test_toxic_texts_are_found(spark, model):
    rows = texts(0, 400)
    scores = toxicity.log_odds(pa.array([t for _, t, _ in rows]), *model)
    found = (scores > 0) == np.array([y == 1 for *_, y in rows])
    assert found.mean() > 0.97


def test_a_small_sample(spark):
    rows = spark.createDataFrame(texts(1, 600), "id long, text string, toxic int")
    drawn = toxicity.labelled_texts(rows.select("id", "text").union(rows.select("id", "text")), rows.select("id", "toxic"), 150)
    assert drawn.count() == 150 and drawn.join(rows, ["id", "text", "toxic"]).count() == 150
    small = toxicity.fit(drawn)
    tests = texts(4, 200)
    scores = toxicity.log_odds(pa.array([t for _, t, _ in tests]), *small)
    assert ((scores > 0) == np.array([y == 1 for *_, y in tests])).mean() > 0.9


def test_training_is_the_same_each_time(spark, model):
    again = toxicity.fit(spark.createDataFrame(texts(1, 600), "id long, text string, toxic int").repartition(3))
    assert np.allclose(again[0], model[0], atol=1e-5) and abs(again[2] - model[2]) < 1e-5


def test_gradient_of_the_joint_model():
    """Features that decide get a sign, features without a class next to none."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    x = np.zeros((600, 3), np.float32)
    x[:, 0], x[:, 1], x[:, 2] = y * 0.1, (1 - y) * 0.1, rng.random(600) * 0.02
    log_odds, _ = toxicity.train(x, y)
    assert log_odds[0] > 0 > log_odds[1] and abs(log_odds[2]) < abs(log_odds[0]) / 3


def test_buckets_that_do_not_differ_get_no_vector():
    n0, n1 = np.array([100, 50, 0, 4]), np.array([100, 0, 50, 0])
    assert sorted(toxicity.choose(n0, n1, 1000, 1000)) == [1, 2]


def test_odd_rows(spark):
    rows = spark.createDataFrame(texts(1, 300), "id long, text string, toxic int")
    docs = spark.createDataFrame(
        [(1, None, 5, "a"), (2, "", 6, "b"), (2, "", 6, "b"), (None, "grobnik " * 50, 7, None), (4, "river " * 20000, 8, "c")],
        "doc_id long, text string, Score int, value string")
    learned = docs.unionByName(rows.select((F.col("id") + 1000).alias("doc_id"), "text"), allowMissingColumns=True)
    out = toxicity.score_toxicity(learned, rows.select((F.col("id") + 1000).alias("id"), "toxic")).where("doc_id < 1000 OR doc_id IS NULL")
    assert out.columns == ["doc_id", "text", "value", "score", "predicted"]
    got = {(r.doc_id, r.text and r.text[:5]): r for r in out.collect()}
    assert out.count() == 5 and len({r.score for r in got.values() if not r.text}) == 1
    assert got[None, "grobn"].predicted == 1 and got[4, "river"].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(i, "some words" if i % 2 else None) for i in range(40)], "doc_id long, text string")
    for labels in ([], [(1, None), (2, 5)], [(1000, 1)]):
        found = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "id long, toxic int")).collect()
        assert {(r.score, r.predicted) for r in found} == {(0.0, 0)} and len(found) == 40
    calm = spark.createDataFrame([(i, 0) for i in range(40)], "id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, calm).collect())
    assert toxicity.score_toxicity(docs.limit(0), calm).count() == 0
    empty = docs.withColumn("text", F.lit(""))
    mixed = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, toxic int")
    assert toxicity.score_toxicity(empty, mixed).count() == 40


def test_query_on_held_out_labels(spark):
    rows = toxicity.op12_toxicity(spark, SF).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    seen = rows[rows.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    toxic = seen.toxic == 1
    rank = seen.score.rank()
    area = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.96
    assert seen[toxic].predicted.mean() > 0.8 and seen[~toxic].predicted.mean() < 0.02


def test_the_query_learns_no_held_out_label(spark, tmp_path):
    def tables(flip):
        path = tmp_path / str(flip)
        docs = [(i, t, "en", "s", len(t)) for i, t, _ in texts(1, 300)]
        labels = [(i, 1, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in texts(1, 300)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return toxicity.op12_toxicity(spark, str(path)).orderBy("doc_id").collect()

    assert tables(False) == tables(True)
