import hashlib
import random

import pytest
from tokenizers import Tokenizer

from obscat.llm import bpe
from tests.llm import plain

MORE = [
    "Hello WORLD don't we'll 123abc", "Σίσυφος ΣΑΣ", "<|endoftext|>abc <|startoftext|>x<|endoftext", "a" * 300 + "!!!???", "İstanbul ̈x", "x\x1cy\x1d z\x85w​q",
    " <|ENDOFTEXT|>", "՘ Ᲊ Ɤ \U00010d50 \U00016ea0", "it's 'S 'RE '''", "\x00 � ퟿", "fi ﬁ ǅ ß ẞ",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    with open(bpe.vocabulary_path(), encoding="utf-8") as file:
        return bpe.WordBpe(file.read())


def test_ids_and_decoded_text_are_the_librarys(own, library):
    rnd = random.Random(5)
    texts = [t or "" for t in plain.EDGE_TEXTS] + MORE
    texts += ["".join(rnd.choice("abcdehilnorstuw ") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice((rnd.randint(1, 0x2FF), rnd.randint(0x300, 0xD7FF), rnd.randint(0x10000, 0x1FFFF)))) for _ in range(12)) for _ in range(3000)]
    for text, (ids, decoded) in zip(texts, own.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_results_do_not_depend_on_a_full_table(library, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LETTERS", 30)
    with open(bpe.vocabulary_path(), encoding="utf-8") as file:
        small = bpe.WordBpe(file.read())
    for _ in range(3):
        for text in ("one two three four", "four five six", "one six seven"):
            assert small.encode([text])[0][1] == library.decode(library.encode(text, add_special_tokens=False).ids)


def test_table_of_documents(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in enumerate(plain.EDGE_TEXTS)], "doc_id long, text string, N_TOKENS string, kept int, ids double")
    found = {r.doc_id: r for r in bpe.encode_decode(docs, bpe.vocabulary_path()).collect()}
    assert len(found) == len(plain.EDGE_TEXTS)
    for i, text in enumerate(plain.EDGE_TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids) and (found[i].kept, found[i].ids) == (1, 2.0)
        assert found[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = bpe.encode_decode(docs, bpe.vocabulary_path(), with_values=True).where("doc_id = 4").first()
    assert whole.ids == library.encode("Two words").ids and whole.decoded == "two</w> words</w>"
    assert bpe.encode_decode(docs.limit(0), bpe.vocabulary_path()).count() == 0


def test_pairs_of_tokens_are_told_apart_without_merging_their_letters_again(own, monkeypatch):
    rnd = random.Random(9)
    names = [t for t in own.vocab.values() if not own.names[t].endswith(own.end)]
    parts = rnd.sample(sorted((a, b) for _, a, b in own.made.values()), 300)
    pairs = parts + [(rnd.choice(names), rnd.choice(list(own.vocab.values()))) for _ in range(1500)] + [(t, t) for t in rnd.sample(names, 200)]
    want = [own.merged(own.symbols(own.names[a]) + own.symbols(own.names[b])) == [own.names[a], own.names[b]] for a, b in pairs]
    assert [own.stay_apart(a, b) for a, b in pairs] == want and 100 < sum(want) < len(want) - 100
    calls, merged = [], own.merged
    monkeypatch.setattr(own, "merged", lambda parts: calls.append(tuple(parts)) or merged(parts))
    own.encode([" ".join("".join(rnd.choice("abcdehilnorstuw") for _ in range(9)) for _ in range(2000))])
    assert len(calls) == len(set(calls)) <= len(own.vocab) and set(map("".join, calls)) <= set(own.vocab)
