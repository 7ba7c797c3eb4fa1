import random

from pyspark.sql import functions as F

from obscat.llm import decontam
from tests.llm import plain


def corpus(seed=7):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rnd.randint(12, 50))) for i in range(25)] + [(100, "only three words"), (101, None), (102, ""), (103, "again and again and again and again and again and")]
    items += [(104, items[0][1]), (None, "an item without an id that is long enough here")]
    docs = []
    for i in range(150):
        body = text(rnd.randint(0, 200)).split(" ")
        for _ in range(rnd.choice((0, 1, 1, 2))):
            item = (rnd.choice(items)[1] or "").split(" ")
            for _ in range(rnd.choice((0, 0, 1, 2))):
                item[rnd.randrange(len(item))] = word()
            at = rnd.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body).title()))
    docs += [(1000 + i, t) for i, t in enumerate(plain.EDGE_TEXTS)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    found = decontam.leaks(
        spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, words int"),
        spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string"))
    got = {(r.doc_id, r.item_id): (r.start_word, r.end_word, r.similarity) for r in found.collect()}
    want = plain.best_windows(docs, items)
    exact = {k: v for k, v in want.items() if v[2] >= 0.9}
    assert all(got[k] == v for k, v in exact.items() if k in got)
    assert set(got) <= set(want) and not set(exact) - set(got)
    assert len(set(want) - set(got)) <= 0.1 * len(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.leaks(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in decontam.leaks(docs, items).collect()] == [(1, 1, 0, 2, 1.0)]


def test_multi_index_finds_all_within_the_radius(spark):
    rnd = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rnd.getrandbits(64) for _ in range(20)]
    asked = []
    for b in base:
        for n in (0, 1, decontam.RADIUS - 1, decontam.RADIUS, decontam.RADIUS + 1, 30):
            asked.append(b ^ sum(1 << i for i in rnd.sample(range(64), n)))
    items = spark.createDataFrame([(i, 10, signed(b)) for i, b in enumerate(base)], "item long, size long, item_fp long")
    found = decontam.within_radius(spark.createDataFrame([(10, signed(a)) for a in asked], "size long, fp long"), items)
    got = {(r.fp, r.item) for r in found.collect()}
    assert got == {(signed(a), i) for a in asked for i, b in enumerate(base) if (a ^ b).bit_count() <= decontam.RADIUS}
    assert found.where(F.col("size") != 10).count() == 0
