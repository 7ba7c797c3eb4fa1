import math

import numpy as np
import pytest

from obscat.llm import topk

KIND = "vec_id long, embedding array<float>, id string, v string"


def brute(rows, k, is_query):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def found(spark, rows, k, is_query):
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], KIND), "vec_id", "embedding")
    return {tuple(r) for r in topk.top_k(vectors, vectors.where(is_query), k).collect()}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT_ROWS", 100)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 7)
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=8)]) for i in range(600)]
    rows += [(i, rows[i % 7][1]) for i in range(600, 640)] + [(700, None), (701, []), (750, [1.0, None]), (800, [math.nan] * 8), (850, [math.inf] * 8), (None, [1.0] * 8), (900, [0.5] * 3), (950, [0.0] * 8)]
    assert found(spark, rows, 5, "id % 50 = 0") == brute(rows, 5, lambda q: q % 50 == 0)


def test_few_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])]
    assert found(spark, rows, 5, "id = 0") == {(0, 1, 1, 65536), (0, 2, 3, 65536), (0, 3, 2, -65536)}
    assert found(spark, [(0, [1.0])], 5, "true") == set()
    assert found(spark, [], 5, "true") == set()


def test_large_components_fail_instead_of_wrapping(spark):
    with pytest.raises(Exception, match="component too large"):
        found(spark, [(0, [1e30]), (1, [1.0])], 5, "true")


def test_groups_that_meet_every_segment_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "SEGMENT_ROWS", 40)
    rows = [(i, [float(i % 11), float(i % 7) - 3]) for i in range(900)]
    vectors = topk.integer_vectors(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], KIND), "vec_id", "embedding")
    plan = topk.top_k(vectors, vectors.where("id % 50 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_groups_are_numbered_without_gaps_over_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "PARTS", 3)
    vectors = topk.integer_vectors(spark.createDataFrame([(i, [0.5 * i] * (1 + i % 4), "x", "y") for i in range(200)], KIND), "vec_id", "embedding")
    groups, n = topk.numbered(topk.written(topk.groups_of(vectors, ["id"], 200, 15), "test-groups"))
    packed = groups.collect()
    assert sorted(r.segment for r in packed) == list(range(n)) and n >= 14
    ids = [np.frombuffer(r.ids, np.int64).tolist() for r in packed]
    assert sorted(sum(ids, [])) == list(range(200)) and max(map(len, ids)) <= 15
    monkeypatch.setattr(topk, "PARTS", 2)
    monkeypatch.setattr(topk, "GROUP_BYTES", 100)
    monkeypatch.setattr(topk, "SEGMENT_ROWS", 50)
    rows = [(i, [float(i % 13), 1.0, float(i % 5)]) for i in range(300)]
    assert found(spark, rows, 4, "id % 50 = 0") == brute(rows, 4, lambda q: q % 50 == 0)
