"""Whitening against exact sums and a dense eigensolver; the qd solver on matrices with known values."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from obscat.llm import whitening

SF = "/root/testdata/sf0.01"


def singular(q, e):
    b = np.diag(np.sqrt(q)) + np.diag(np.sqrt(e), 1)
    return np.linalg.svd(b, compute_uv=False) ** 2


@pytest.mark.parametrize("seed", range(12))
def test_dqds_on_random_bidiagonals(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    q, e = rng.random(n) ** 3 + 1e-3, rng.random(n - 1) ** 2
    if seed % 3 == 0 and n > 4:
        e[n // 2] = 0
    got = np.array(whitening.dqds(q.tolist(), e.tolist()))
    assert np.allclose(got, singular(q, e), rtol=1e-11, atol=1e-14)


def test_dqds_keeps_the_digits_of_tiny_values():
    """Graded by 1e-30: the product of the values is that of the diagonal, exactly, and so is their inverse trace."""
    q = [10.0 ** (-3 * i) for i in range(11)]
    e = [10.0 ** (-3 * i - 4) for i in range(10)]
    got = whitening.dqds(q, e)
    product, trace = Fraction(1), Fraction(0)
    for x in q:
        product *= Fraction(x)
    row = Fraction(0)
    for i in range(10, -1, -1):
        row = (1 + (Fraction(e[i]) * row if i < 10 else 0)) / Fraction(q[i])
        trace += row
    result = Fraction(1)
    for x in got:
        result *= Fraction(x)
    assert abs(float(result / product) - 1) < 1e-13
    assert abs(sum(1 / x for x in got) / float(trace) - 1) < 1e-13
    assert got[-1] < 1e-29


def test_dqds_with_zero_values():
    assert np.allclose(whitening.dqds([4.0, 0.0, 1.0], [0.0, 0.0]), [4, 1, 0])
    q, e = [0.0, 2.0, 3.0, 0.0], [1.0, 0.5, 0.25]
    assert np.allclose(whitening.dqds(q, e), singular(q, e), atol=1e-14)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_bidiagonal(n):
    r = np.triu(np.random.default_rng(n).normal(size=(n, n)))
    diagonal, above, p = whitening.bidiagonal(r)
    b = np.diag(diagonal) + np.diag(above, 1)
    assert np.allclose(p.T @ p, np.eye(n), atol=1e-13)
    assert np.allclose(b.T @ b, p.T @ (r.T @ r) @ p, atol=1e-11)


def check(x, most=32):
    r = np.linalg.qr(x - x.mean(axis=0), mode="r")
    r = np.vstack([r, np.zeros((max(x.shape[1] - len(r), 0), x.shape[1]))])
    values, directions, total = whitening.principal(r, most)
    cov = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    want = np.linalg.eigvalsh(cov)[::-1]
    assert np.allclose(values, want[: len(values)], rtol=1e-9, atol=1e-12 * want[0])
    assert abs(total - np.trace(cov)) <= 1e-11 * total
    assert np.allclose(directions.T @ directions, np.eye(len(values)), atol=1e-11)
    assert np.abs(cov @ directions - directions * values).max() <= 1e-11 * want[0]
    return values


def test_principal_directions():
    rng = np.random.default_rng(1)
    assert len(check(rng.normal(size=(300, 64)) @ np.diag(1.1 ** -np.arange(64.0)))) == 32
    assert len(check(rng.normal(size=(300, 5)))) == 5
    # fewer rows than dimensions, a constant and a repeated dimension: directions without variance are left out
    assert len(check(rng.normal(size=(7, 20)))) == 6
    x = rng.normal(size=(100, 6))
    x[:, 3], x[:, 4] = 5, x[:, 1]
    assert len(check(x)) == 4


def test_equal_and_almost_equal_values():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(200, 40)))[0]
    q -= q.mean(axis=0)
    check(np.linalg.qr(q)[0] @ np.linalg.qr(rng.normal(size=(40, 40)))[0])
    n = 21  # a glued tridiagonal matrix with pairs that agree to many digits
    wilkinson = np.diag(np.abs(np.arange(n) - n // 2).astype(float)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1) + 2 * np.eye(n)
    r = np.linalg.cholesky(wilkinson).T
    values, directions, _ = whitening.principal(r, n)
    assert np.allclose(values, np.linalg.eigvalsh(wilkinson)[::-1], rtol=1e-12)
    assert np.allclose(directions.T @ directions, np.eye(n), atol=1e-10)
    assert np.abs(wilkinson @ directions - directions * values).max() < 1e-10


def plain(vectors):
    """``(n, deviations, covariance, centred)`` in exact numbers where the contract asks for them."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    return n, deviation, centred.T @ centred / n, centred


def rows_of(spark, vectors, **kwargs):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    return whitening.whiten(frame.repartition(5), **kwargs)


def compare(found, vectors):
    n, deviation, cov, centred = plain(vectors)
    z = np.array([r.whitened for r in found])
    assert [int(r.deviation_exact) for r in found] == deviation and found[0].n == n
    k = z.shape[1]
    values, directions = np.linalg.eigh(cov)
    assert np.allclose(found[0].explained, values[::-1][:k] / np.trace(cov), rtol=1e-6)
    want = (centred @ directions[:, ::-1][:, :k]) / np.sqrt(values[::-1][:k])
    assert np.allclose(np.abs(z), np.abs(want), atol=1e-7)
    error = np.abs(np.cov(z.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert found[0].identity_error <= 1e-9 and abs(found[0].identity_error - error) < 1e-9


def test_rows_equal_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(400, 8)) * 1.5 ** np.arange(8)).astype(np.float32).tolist()
    found = sorted(rows_of(spark, vectors).collect(), key=lambda r: r.vec_id)
    compare(found, vectors)


def test_odd_vectors_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(50, 3)).tolist()
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 1.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "a", 1, None) for i, v in enumerate(good + odd)] + [(0, good[0], "twice", 2, None), (None, good[1], None, 3, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, value string, n int, Whitened string")
    found = whitening.whiten(frame)
    assert found.columns == ["vec_id", "value", "whitened", "n", "deviation_exact", "explained", "identity_error"] or set(found.columns) == {
        "vec_id", "value", "deviation_exact", "whitened", "n", "explained", "identity_error"}
    got = found.collect()
    assert len(got) == 52 and got[0].n == 52
    compare(sorted(got, key=lambda r: (r.vec_id is None, -1 if r.vec_id is None else r.vec_id, r.value or "")), good[:1] + good[:1] + good[1:] + good[1:2])


def test_no_variance_no_rows_and_no_table(spark):
    assert rows_of(spark, [[1.0, 2.0]] * 5).count() == 0
    assert rows_of(spark, []).count() == 0
    assert rows_of(spark, [None, []]).count() == 0


def test_huge_entries_do_not_overflow(spark):
    vectors = [[1e30, 0.0], [-1e30, 1.0], [3e300, 2.0], [0.0, 3.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = whitening.whiten(frame).collect()
    assert len(found) == 4 and all(np.isfinite(r.whitened).all() for r in found)
    most = whitening.MOST
    x = [[max(-most, min(most, 64 * int(a))) + 1_000_000, 64 * int(b) + 1_000_000] for a, b in vectors]
    sums = [sum(c) for c in zip(*x)]
    assert sorted(int(r.deviation_exact) for r in found) == sorted(sum((4 * a - s) ** 2 for a, s in zip(row, sums)) for row in x)


def test_query(spark):
    rows = whitening.op13_whitening(spark, SF)
    assert rows.where("identity_error > 0.0001 OR deviation IS NULL").count() == 0
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows.count() == 32 * table.where(F.col("embedding").isNotNull()).count()
    wide = rows.groupBy("vec_id").agg(F.first("n").alias("n"), F.first("deviation").alias("deviation_exact"), F.first("identity_error").alias("identity_error"),
        F.transform(F.sort_array(F.collect_list(F.struct("component", "whitened"))), lambda c: c["whitened"]).alias("whitened"),
        F.transform(F.sort_array(F.collect_list(F.struct("component", "explained"))), lambda c: c["explained"]).alias("explained"))
    vectors = [r.embedding for r in table.orderBy("vec_id").collect()]
    compare(wide.orderBy("vec_id").collect(), vectors)
