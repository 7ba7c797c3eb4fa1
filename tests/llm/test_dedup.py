import random

from pyspark.sql import functions as F

from obscat.llm import dedup
from tests.llm import plain

KIND = "doc_id long, text string, n_shingles string, root int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


def near_copies(n, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for group in range(n):
        base = [word() for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 6))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rnd.shuffle(rows)
    return rows


def check(spark, rows, k, percent):
    found = dedup.near_duplicates(frame(spark, rows), k, percent, 8).collect()
    want = plain.near_classes([r for r in rows if r[0] is not None], k, percent)
    assert len(found) == len(rows)
    for r in found:
        assert r.root == 1
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_equals_brute_force(spark):
    check(spark, near_copies(60), 3, 85)
    check(spark, near_copies(60, 4), 5, 80)


def test_cases(spark):
    rows = [(100 + i, t) for i, t in enumerate(plain.EDGE_TEXTS)] + [(7, "same text twice here"), (7, "same text twice here"), (3, "SAME text  twice here"), (50, "x" * 5000)]
    rows += [(200, "one"), (201, "completely different words than others have"), (200, "completely different words than others have")]
    check(spark, rows, 3, 85)
    sizes = {r.doc_id: r.n_shingles for r in dedup.near_duplicates(frame(spark, rows), 3, 85, 7).collect()}
    assert sizes[100] == sizes[101] == sizes[102] == 0 and sizes[103] == sizes[104] == 1 and sizes[105] == 5
    with_null = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d")]
    found = dedup.near_duplicates(frame(spark, with_null), 3, 85, 7).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found if r.doc_id) == [(1, 1, True)] and all(r.kept for r in found if r.doc_id is None)
    assert dedup.near_duplicates(frame(spark, []), 3, 85, 7).count() == 0


def test_a_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200, 2)] + [(i + 1, i) for i in range(1, 199, 2)] + [(500, 501)], "x long, y long")
    roots = {r.id: r.root for r in dedup.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(200)}, 500: 500, 501: 500}


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[rnd.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    found = dedup.near_duplicates(frame(spark, rows), 3, 85, 7).collect()
    assert {r.component_id for r in found} == {0}


def test_no_pair_of_a_bucket_goes_unseen(spark, monkeypatch):
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rnd.randint(2, 9)):
            copy[rnd.randrange(300)] = f"x{rnd.random()}"
        texts.append((i, " ".join(copy)))
    signed = frame(spark, texts).select(F.struct(F.col("doc_id").alias("id")).alias("kept"), "text") \
        .mapInArrow(dedup._signatures(3, 7), "kept struct<id:bigint>, a long, b long, n long, mins binary, bins binary").selectExpr("kept.id AS id", "n", "mins", "bins").persist()
    keyed = signed.select("id", "mins").mapInArrow(dedup._table_keys(7), "key long, id long")
    members = keyed.join(signed.select("id", "n"), "id").withColumn("root", F.col("id") % 20)
    shared = {}
    for r in keyed.collect():
        shared.setdefault(r.key, []).append(r.id)
    sets = {i: set(plain.shingle_list(plain.words(t), 3)) for i, t in texts}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    shares = {(a, b) for ids in shared.values() for a in ids for b in ids if a < b and a % 20 != b % 20}
    want = {p for p in shares if alike(*p) >= 0.85}
    for block in (512, 7):
        monkeypatch.setattr(dedup, "BLOCK", block)
        found = [tuple(r) for r in dedup.unlinked_pairs(members, signed, 85, 7).collect()]
        assert len(want) > 20 and want <= set(found) <= shares and len(found) == len(set(found))
        assert sum(alike(*p) < 0.75 for p in found) == 0


def test_pairs_close_to_the_limit_are_settled_in_their_block(spark, monkeypatch):
    rnd = random.Random(8)
    texts = []
    for n, count, changes in ((120, 150, (1, 2, 2, 2, 2, 2, 2, 2)), (700, 14, (9, 10, 11, 12))):
        base = [f"w{n}x{i}" for i in range(n)]
        for _ in range(count):
            copy = list(base)
            for at in rnd.sample(range(n), rnd.choice(changes)):
                copy[at] = f"y{rnd.random()}"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    asked, written = [], dedup.written

    def counted(df, purpose, *more):
        out = written(df, purpose, *more)
        if purpose == "pairs":
            asked.append(out.count())
        return out

    monkeypatch.setattr(dedup, "written", counted)
    check(spark, rows, 3, 85)
    assert asked[1] < len(rows)
    assert max(map(len, (dedup.shingle_sets(dedup.pa.array([t]), 3)[0] for t in texts))) > dedup.WHOLE


def test_links_that_join_nothing_new_are_not_given_out():
    sets = [dedup.np.arange(a, a + 100, dtype=dedup.np.uint64).tobytes() for a in (0, 2, 4, 500)] + [b""]
    left, right = dedup.np.array([0, 0, 1, 0, 3, 4, 4]), dedup.np.array([1, 2, 2, 3, 4, 0, 1])
    above = {}
    go = dedup._joining(left, right, dedup.np.array([7, 8, 9, 5, 7]), sets, above, 85)
    assert sorted(go.tolist()) == [0, 1, 4] and len(above) == 2
