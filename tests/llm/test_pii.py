import hashlib
import random

import pyarrow as pa

from obscat.llm import pii
from obscat.llm.spans import Texts
from tests.llm import plain

TEXTS = plain.EDGE_TEXTS + [
    "é a.b@c.de, x@y z@@w.de a@b.c@d.e @x.y .@-.-", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9 1..2.3.4 1.2.3 1.2.3.", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111",
    "+1 (663) 555-6869 +1234567 +12345678+12345678 +1 +49-", "a@b.c." + "1" * 50, "0" * 40 + " " + "0" * 16, "mail:user%x@host-.a_b", "1.1.1.1@2.2.2.2", "+1.2.3.4444",
    "1.2.3." + "0" * 5000 + "1 1.2.3." + "0" * 5000 + "256", "9" * 6000 + ".1.2.3",
]


def test_patterns_equal_brute_force():
    rnd = random.Random(6)
    parts = ["a", "@", ".", "-", "+", " ", "1", "23", "456", "4111111111111111", "(", ")", "é", "b.c", "@d.e", "%"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(6000)]
    found = Texts(pa.array(texts))
    spans = found.by_row(pii.entities(found))
    for i, text in enumerate(texts):
        assert sorted(spans.get(i, [])) == sorted(plain.personal(text)), text


def test_table_of_documents(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string, near int")
    found = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert len(found) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = plain.spelled(plain.personal(text))
        assert found[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and found[i].spans.startswith(want) and found[i].near == 1
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_telling_terms(spark):
    rows = [(i, f"filler words number{i} stand here without anything to hide") for i in range(200)]
    rows += [(1000 + i, f"write to Zebulon at z{0}@example.org for the rest of it") for i in range(3)]
    rows += [(2000, "for the rest of it"), (2001, "Zebulon")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in pii.find_pii(docs).collect():
        found.setdefault(r.doc_id, r)
    assert "email:20:34" in found[1000].spans
    terms = {docs_text(rows, 1000)[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[1000].spans.split(",")) if k == "remove"}
    assert {"write", "at"} <= terms and "the" not in terms
    assert found[2001].spans == found[0].spans == ""
    clean = pii.find_pii(docs, sanitise=True).where("doc_id = 1000").first().text
    assert "[email]" in clean and "write" not in clean and "the rest" in clean


def docs_text(rows, doc_id):
    return next(t for i, t in rows if i == doc_id)
