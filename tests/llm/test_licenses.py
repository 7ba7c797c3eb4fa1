import random

from obscat.llm import licenses
from tests.llm import plain

TEXTS = plain.EDGE_TEXTS + [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by nc cc-by-nc", "under the MIT license under the mit license",
    "under the apache mit license", "This work is licensed under the GNU General Public License, version 3.", "underéthe mit license", "apache license version 2apache license version 2",
    "This work is licensed by us under the GNU General Public License of version 3", "license version 2 cc by", "under THE " * 500 + "mit License",
]


def test_base_places_equal_brute_force(spark):
    rnd = random.Random(8)
    parts = "under the mit license apache version 2 cc by nc other of".split()
    texts = TEXTS + [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, Score string, kept int")
    found = {r.doc_id: r for r in licenses.scan_licences(docs).collect()}
    for i, text in enumerate(texts):
        n, hits = plain.places(text, licenses.PHRASES)
        row = found[i]
        assert (row.n_words, row.n_base, row.base_labels) == (n, len(hits), ",".join(sorted({x for _, x in hits}))), text
        assert (row.first_word, row.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert {x for _, x in hits} <= set(row.labels.split(",")) and 0 <= row.score <= 1 and row.kept == 1
    assert licenses.scan_licences(docs.limit(0)).count() == 0


def test_notices(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {TEXTS[r.doc_id]: r.labels for r in licenses.scan_licences(docs).collect()}
    assert labels["This work is licensed under the GNU General Public License, version 3."] == "gpl-3"
    assert labels["This work is licensed by us under the GNU General Public License of version 3"] == "gpl-3"
    assert labels["under the apache mit license"] == "" and labels["license version 2 cc by"] == ""


def test_matching_statistics_equal_brute_force():
    rnd = random.Random(9)
    for _ in range(300):
        templates = [[rnd.randrange(3) for _ in range(rnd.randint(1, 8))] for _ in range(rnd.randint(1, 4))]
        automaton = licenses.SuffixAutomaton(templates)
        words = [rnd.randrange(4) for _ in range(20)]
        for i, (state, length) in enumerate(automaton.matching(words)):
            ends = lambda n: {(t, e) for t, x in enumerate(templates) for e in range(n, len(x) + 1) if x[e - n : e] == words[i + 1 - n : i + 1]}
            want = max(n for n in range(i + 2) if n == 0 or ends(n))
            assert length == want
            if length:
                assert set(automaton.states[state].ends) == ends(length)
