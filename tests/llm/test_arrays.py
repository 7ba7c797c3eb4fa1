import random

import numpy as np
import pyarrow as pa

from obscat.llm.arrays import ALNUM_WORD, WORD, pieces, shingles, stretch_hashes, words
from tests.llm import plain


def random_texts(n, seed=1):
    rnd = random.Random(seed)
    return [None if rnd.random() < 0.1 else "".join(rnd.choice("ab Cé9\n.\t漢") for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    texts = random_texts(300) + plain.EDGE_TEXTS
    for table, pattern in ((WORD, plain.WORD), (ALNUM_WORD, plain.ALNUM)):
        data, starts, ends, first = words(pa.array(texts), table)
        found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        assert [found[first[i] : first[i + 1]] for i in range(len(texts))] == [plain.words(t, pattern) for t in texts]


def test_equal_shingles_have_equal_hashes_and_no_others():
    texts = random_texts(300, 2) + plain.EDGE_TEXTS
    data, starts, ends, first = words(pa.array(texts))
    values, bounds = shingles(stretch_hashes(data, starts, ends), first, 3)
    names = {}
    for i, text in enumerate(texts):
        want = plain.shingle_list(plain.words(text), 3)
        have = values[bounds[i] : bounds[i + 1]].tolist()
        assert len(want) == len(have)
        for s, h in zip(want, have):
            assert names.setdefault(s, h) == h
    assert len(set(names.values())) == len(names)


def test_pieces_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 50, 3, 3)] + [None]})
    parts = list(pieces(batch, "text", 8))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert max(len(p) for p in parts) < 6 and list(pieces(batch.slice(0, 0), "text")) == []


def test_no_words_at_all():
    data, starts, ends, first = words(pa.array([None, ""], pa.string()))
    values, bounds = shingles(stretch_hashes(data, starts, ends), first, 5)
    assert not len(values) and bounds.tolist() == [0, 0, 0] and isinstance(starts, np.ndarray)
