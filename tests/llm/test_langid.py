import numpy as np

from obscat.llm import langid

KIND = "doc_id long, text string, lang string, score string, letters int"
EN = "the cat and the other thing were there with that weather"
DE = "der hund und die andere sache waren dort mit diesem wetter"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


def test_hash_is_that_of_spark(spark):
    values = np.array([0, 1, 2**63 - 1, 123456789, 32 << 42], np.int64)
    want = [r[0] for r in spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "i int, x long").orderBy("i").select(langid.hashed("x")).collect()]
    assert langid.spark_xxhash64(values.view(np.uint64)).tolist() == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.op4_langid(spark, "/root/testdata/sf0.001").toPandas().merge(docs.toPandas(), on="doc_id")
    held_out = found[found.held_out & found.lang.notna()]
    assert len(found) == docs.count() and len(held_out) and (held_out.lang == held_out.lang_pred).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_cases(spark):
    rows = [(1, EN, "en"), (2, DE, "de"), (3, None, "en"), (4, "12 34 !", "de"), (5, "", None), (6, EN.upper(), None), (7, "und die sache mit dem hund", None), (7, "und die sache mit dem hund", None), (8, (EN + " ") * 2000, None), (None, "漢字", None)]
    docs = table(spark, rows)
    found = langid.identify(docs.select("doc_id", "text", "letters"), docs.select("text", "lang")).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in found}
    assert got[3] == got[4] == got[5] == ("und", False)
    assert got[1][0] == got[6][0] == got[8][0] == "en" and got[2][0] == got[7][0] == "de"
    assert got[None][0] in ("en", "de") and all(0 <= r.score <= 1 for r in found)


def test_no_training_rows_and_empty_table(spark):
    docs = table(spark, [(1, EN, None)])
    assert [r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), docs.select("text", "lang")).collect()] == ["und"]
    trained = table(spark, [(1, EN, "en")])
    assert langid.identify(docs.limit(0).select("doc_id", "text"), trained.select("text", "lang")).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    langs, parts = langid.sorted_arrays(langid.train(table(spark, [(1, EN * 3, "en"), (2, DE, "de")]).select("text", "lang")))
    letters = sorted({*EN, " "})
    contexts = [(" ", " "), ("t", "h"), ("q", "x")]
    for a, b in contexts:
        grams = np.array([ord(a) << 42 | ord(b) << 21 | ord(c) for c in letters], np.uint64)
        low, last = grams & np.uint64((1 << 42) - 1), grams & np.uint64((1 << 21) - 1)
        codes = {"p3": grams, "p2": low, "p1": last, "g2": grams >> np.uint64(21), "g1": low >> np.uint64(21)}
        p = np.exp(langid.log_probabilities(grams, {k: langid.spark_xxhash64(v) for k, v in codes.items()}, parts))[:, langs.index("en")]
        assert 0.9 < p.sum() < 1.001


def test_every_trigram_has_an_entry_of_its_own(spark):
    rnd = np.random.default_rng(4)
    words = np.unique(rnd.integers(0x4E00, 0x9000, (90_000, 3)), axis=0)
    text = " ".join("".join(map(chr, w)) for w in words)
    grams = {g for w in text.split(" ") for g in zip("  " + w, " " + w + " ", w + "  ") if g[1:] != (" ", " ")}
    found = langid.train(table(spark, [(1, text, "zh")]).select("text", "lang"))
    assert found.where("part = 'p3'").select("h").distinct().count() == len(grams) > 1 << 18


def test_joined_trigrams_score_like_held_ones(spark, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (EN + " zebra zebra", "en"), ("wo ist der zug nach köln", "de"), ("quilt", "en")])]
    rows += [(10, "unseen xylophone köln 漢字 " + DE, None), (11, None, None), (12, "", None), (12, "zebra " * 500, None)]
    docs = table(spark, rows)
    langs, parts = langid.sorted_arrays(langid.train(docs.select("text", "lang")))
    grams, words = langid.word_trigrams(*langid.distinct_words([rows[5][1]])[:3])
    low, last = grams & np.uint64((1 << 42) - 1), grams & np.uint64((1 << 21) - 1)
    codes = {"p3": grams, "p2": low, "p1": last, "g2": grams >> np.uint64(21), "g1": low >> np.uint64(21)}
    logs = langid.log_probabilities(grams, {k: langid.spark_xxhash64(v) for k, v in codes.items()}, parts)
    times = np.bincount(*langid.distinct_words([rows[5][1]])[4:6])
    plain = -(logs * times[words][:, None]).sum(axis=0) / times[words].sum()
    for hot in (0, 20, 1 << 18):
        monkeypatch.setattr(langid, "HOT", hot)
        model = langid.Model(docs.select("text", "lang"))
        assert model.langs == langs and len(model.hot.value[0]) <= hot and (hot < 20 or len(model.hot.value[0]))
        found = langid.entropies(docs.select("doc_id", "text"), model).collect()
        assert len(found) == len(rows)
        np.testing.assert_allclose([r.entropies for r in found if r.doc_id == 10][0], plain, rtol=1e-5)


def test_probabilities_equal_counts_by_hand(spark):
    from tests.llm.plain import KneserNey, one_discount

    texts = {"en": "the cat and the hat sat there then", "de": "die katze und der hut saßen dort dann das"}
    windows = lambda w: [f"  {w} "[i : i + 3] for i in range(len(w) + 1)]
    langs, parts = langid.sorted_arrays(langid.train(table(spark, [(i, t, lang) for i, (lang, t) in enumerate(texts.items())]).select("text", "lang")))
    for column, lang in enumerate(langs):
        by_hand = KneserNey([g for w in texts[lang].split() for g in windows(w)], 3, one_discount)
        grams = [g for w in ["the", "katze", "zebra", "ßen"] for g in windows(w)]
        packed = np.array([sum(ord(c) << (langid.CHAR * (2 - i)) for i, c in enumerate(g)) for g in grams], np.uint64)
        low, last = packed & np.uint64((1 << 42) - 1), packed & np.uint64((1 << 21) - 1)
        codes = {"p3": packed, "p2": low, "p1": last, "g2": packed >> np.uint64(21), "g1": low >> np.uint64(21)}
        got = langid.log_probabilities(packed, {k: langid.spark_xxhash64(v) for k, v in codes.items()}, parts)[:, column]
        np.testing.assert_allclose(got, [np.log(by_hand.probability(g)) for g in grams], rtol=2e-5, atol=2e-5)
