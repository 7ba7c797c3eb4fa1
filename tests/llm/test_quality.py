import numpy as np

from obscat.llm import arrays, quality

KIND = "doc_id long, lang string, text string, kept string, id int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


def good(i):
    rnd = np.random.default_rng(i)
    return " ".join(rnd.choice("the of and to in cat dog house was there with water over under long".split(), 60)).capitalize() + "."


ROWS = [(i, "en", good(i)) for i in range(120)] + [
    (200, "en", good(200)), (201, "en", "X!!Z %%% ### QQQ!! " * 30), (202, "en", None), (203, "en", ""), (204, None, good(204)), (205, "xx", good(205)),
    (206, "en", good(206) * 200), (207, "en", "the"), (200, "en", good(200)), (None, "en", good(5)),
]


def test_junk_goes_and_good_text_stays(spark):
    docs = table(spark, ROWS)
    trusted = spark.range(120)
    found = quality.score_quality(docs, trusted).collect()
    assert len(found) == len(ROWS)
    kept = {r.doc_id: r.kept for r in found}
    assert [kept[i] for i in (200, 201, 202, 203, 204, 205, 206, 207, None)] == [True, False, False, False, True, True, True, True, True]
    assert sum(r.kept for r in found if r.doc_id is not None and r.doc_id < 120) >= 118
    by_id = {r.doc_id: r for r in found}
    assert by_id[202].perplexity is None and by_id[203].n_scored == 0 and by_id[206].n_scored == len(good(206)) * 200 and by_id[201].id == 1


def test_without_trusted_text_only_empty_texts_go(spark):
    found = quality.score_quality(table(spark, ROWS), spark.range(0)).collect()
    assert {r.doc_id for r in found if not r.kept} == {202, 203}
    assert quality.score_quality(table(spark, ROWS).limit(0), spark.range(5)).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = table(spark, ROWS[:120])
    parts = quality.sorted_arrays(quality.trained(docs.select("text")))
    characters = sorted({c for _, _, t in ROWS[:120] for c in t})
    for context in ("the", "  w", "zzz", "\n\n\n"):
        packed = [sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(context + c)) for c in characters]
        assert 0.95 < np.exp(quality.log_probabilities(np.array(packed, np.uint64), parts)).sum() < 1.001


def test_grams_are_those_of_each_text():
    packed, bounds = quality.grams(["ab", "", "c7"])
    spell = lambda g: "".join(chr(int(g) >> (16 * i) & 0xFFFF) for i in (3, 2, 1, 0))
    assert bounds.tolist() == [0, 2, 2, 4] and [spell(g) for g in packed] == ["\n\n\na", "\n\nab", "\n\n\nc", "\n\nc0"]


def test_labels_of_the_tables_are_met(spark):
    found = quality.op2_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().merge(found, on="doc_id")
    assert labels[labels.quality == 0].kept.mean() < 0.1 and labels[(labels.quality == 1) & (labels.toxic == 0)].kept.mean() > 0.95


def test_an_unseen_gram_takes_no_place_of_a_seen_one(spark):
    points = np.unique(np.random.default_rng(2).integers(0x4E00, 0x9000, (20_000, 4)).astype(np.uint64), axis=0)
    packed = points[:, 0] << np.uint64(48) | points[:, 1] << np.uint64(32) | points[:, 2] << np.uint64(16) | points[:, 3]
    slot = arrays.mixed(packed) >> np.uint64(42)
    order = np.argsort(slot)
    i = np.flatnonzero(slot[order][1:] == slot[order][:-1])[0]
    seen, unseen = packed[order[i]], packed[order[i + 1]]
    text = "".join(chr(int(seen) >> s & 0xFFFF) for s in (48, 32, 16, 0))
    parts = quality.sorted_arrays(quality.trained(table(spark, [(1, "zh", text * 5), (2, "zh", good(1))]).select("text")))
    of_seen, of_unseen = quality.log_probabilities(np.array([seen, unseen], np.uint64), parts)
    assert of_unseen < of_seen - 1 and np.isclose(of_unseen, parts["p0"][1][0])


def test_joined_grams_score_like_held_ones(spark, monkeypatch):
    docs = table(spark, [*ROWS[:20], (30, "en", "Unseen 漢字 \U0001F600 text, of cats 42 " * 3), (31, "en", None)])
    trained_on = docs.where("doc_id < 20").select("text")
    parts = quality.sorted_arrays(quality.trained(trained_on))
    want = {r.doc_id: -quality.log_probabilities(quality.grams([r.text])[0], parts).astype(float).mean() for r in docs.collect() if r.text}
    for hot in (0, 50, 1 << 21):
        monkeypatch.setattr(quality, "HOT", hot)
        model = quality.Model(trained_on)
        assert len(model.hot.value[0]) <= hot and (hot < 50 or len(model.hot.value[0]))
        got = {r.doc_id: r.entropy for r in quality.entropies(docs.select("doc_id", "text"), model, "text").collect()}
        assert got.pop(31) == 0 and got.keys() == want.keys()
        np.testing.assert_allclose([got[k] for k in want], list(want.values()), rtol=1e-5)


def test_probabilities_equal_counts_by_hand(spark):
    from tests.llm.plain import KneserNey, three_discounts

    texts = [good(i) for i in range(12)] + ["Zahlen 12 und 345, Ähren.", "漢字 text", "aaaa", "b"]
    windows = lambda t: [("\n\n\n" + t)[i : i + 4] for i in range(len(t))]
    plain = lambda t: "".join("0" if "0" <= c <= "9" else c for c in t)
    by_hand = KneserNey([g for t in texts for g in windows(plain(t))], 4, three_discounts)
    parts = quality.sorted_arrays(quality.trained(spark.createDataFrame([(t,) for t in texts], "text string")))
    for text in [texts[0], texts[12], "Unseen QQ text 99 漢", "zz"]:
        want = [np.log(by_hand.probability(g)) for g in windows(plain(text))]
        np.testing.assert_allclose(quality.log_probabilities(quality.grams([text])[0], parts), want, rtol=2e-5, atol=2e-5)


def test_a_task_that_counts_trusted_text_needs_one_python_worker(spark):
    texts = quality.trusted_texts(table(spark, ROWS), spark.range(120), "doc_id", "text").select("text").mapInArrow(quality._count, "gram long, n long")
    steps = [x for x in str(texts._jdf.queryExecution().executedPlan()).splitlines() if "MapInArrow" in x or "Exchange hashpartitioning" in x]
    arrow = [i for i, x in enumerate(steps) if "MapInArrow" in x]
    assert len(arrow) == 2 and arrow[1] - arrow[0] > 1
