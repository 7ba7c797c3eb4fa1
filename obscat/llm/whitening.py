"""Embedding whitening through the singular values of the centred rows, by a qd solver.

Entries become whole numbers, so counts and sums are exact. Tasks centre their rows and reduce them to a
triangular factor by QR, block after block; factors meet in groups until one is left, so no task holds more
than two factors and a block. The last factor has one row and column per dimension: Householder reflections make it bidiagonal,
differential qd sweeps with shifts that stay below the smallest value (dqds) find its singular values to high
relative accuracy, and twisted factorisations give a vector for each. Values so close that their vectors are not yet
orthogonal get vectors from other twists, made orthogonal to those before.

Cases: a vector that is null, empty or holds a null or non-finite entry takes no part, nor does one of another length
than most vectors have (of equally frequent lengths the longest counts); an entry beyond ``MOST`` counts as ``MOST``;
directions without variance have no component, so equal vectors give no rows; repeated rows and ids count as often as
they stand there; an empty table gives no rows; ``deviation`` is null where it exceeds a long (``deviation_exact`` holds it).
Result columns replace others of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obscat.llm.registry import query, table
from obscat.llm.store import written

#: Fixed values of the contract.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Largest whole number that an entry becomes.
MOST = 1 << 45
#: Rows that a task factors at once.
BLOCK_ROWS = 4096
#: Factors that one task puts together.
FAN_IN = 32
#: A direction whose variance is below this share of the largest has none but rounding.
NO_VARIANCE = 1e-13

_EPS = float(np.finfo(float).eps)


# Whole numbers from vectors

def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with ``x``, the whole numbers of a vector that takes part; the others are left out."""
    entry = F.transform(column, lambda c: c.cast("double"))
    whole = F.transform("_d", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))), F.lit(MOST)), F.lit(-MOST)) + OFFSET)
    fine = F.forall("_d", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = rows.withColumn("_d", entry).where(F.col("_d").isNotNull() & (F.size("_d") > 0) & fine)
    return kept.withColumn("x", whole).drop("_d", column)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as a matrix of whole numbers."""
    column = batch.column("x")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per dimension, in parts that cannot overflow: high and low 32 bits of the entries."""
    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _rows(batch)
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_pydict({"dimension": np.arange(len(high), dtype=np.int32), "high": high, "low": low, "n": np.full(len(high), n)})


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """``(n, S)``: the number of rows and the exact sums of their dimensions."""
    parts = rows.select("x").mapInArrow(_totals, "dimension int, high long, low long, n long")
    sums = parts.groupBy("dimension").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = sorted(tuple(r) for r in sums.collect())
    return (int(found[0][1]) if found else 0), [(int(h) << 32) + int(l) for _, _, h, l in found]


def _times(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S`` in whole numbers."""
    if x.size and n * int(np.abs(x).max()) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _times(x, n, sums).astype(float) / n


# Blockwise QR

def _pack(r: np.ndarray, part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "r": pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())})


def _factor(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    """One triangular factor of all rows of a partition."""
    from pyspark import TaskContext

    r = np.zeros((0, len(sums)))
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            r = np.linalg.qr(np.vstack([r, _centred(_rows(batch.slice(a, BLOCK_ROWS)), n, sums)]), mode="r")
    if len(r):
        yield _pack(r, TaskContext.get().partitionId())


def _join(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """One factor for the factors of every part, which come in order."""
    part, r = None, np.zeros((0, d))
    for batch in batches:
        for number, packed in zip(batch.column("part").to_pylist(), batch.column("r").to_pylist()):
            if part is not None and number != part:
                yield _pack(r, part)
                r = np.zeros((0, d))
            part = number
            r = np.linalg.qr(np.vstack([r, np.frombuffer(packed).reshape(-1, d)]), mode="r")
    if part is not None:
        yield _pack(r, part)


def triangular(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows; square, whatever the number of rows."""
    d = len(sums)
    factors = written(rows.select("x").mapInArrow(partial(_factor, n=n, sums=sums), "part int, r binary"), "whitening-factors")
    left = factors.count()
    while left > 1:
        left = -(-left // FAN_IN)
        grouped = factors.withColumn("part", F.pmod("part", F.lit(left))).repartition(left, "part").sortWithinPartitions("part")
        factors = written(grouped.mapInArrow(partial(_join, d=d), "part int, r binary"), "whitening-factors")
        left = factors.count()
    r = np.frombuffer(factors.first()["r"]).reshape(-1, d)
    return np.vstack([r, np.zeros((max(d - len(r), 0), d))])


# Singular values and vectors of the triangular factor

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, above, P)`` with ``r = U B P'`` for some orthogonal U, by Householder reflections."""
    a = np.array(r, float)
    d = a.shape[1]
    p = np.eye(d)

    def reflection(x: np.ndarray) -> np.ndarray | None:
        if not np.any(x[1:]):
            return None
        scale = np.abs(x).max()
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflection(a[k:, k].copy())
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflection(a[k, k + 1 :].copy())
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _below_smallest(q: list[float], e: list[float]) -> float:
    """1 / trace of the inverse: at most the smallest eigenvalue, and close to it where it stands alone."""
    if min(q) == 0:
        return 0.0
    row, total = 1 / q[-1], 1 / q[-1]
    for i in range(len(q) - 2, -1, -1):
        row = (1 + e[i] * row) / q[i]
        total += row
    return 1 / total


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; None where the shift was beyond the smallest eigenvalue."""
    out_q, out_e = [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        top = d + e[i]
        if top <= 0:
            return None
        ratio = q[i + 1] / top
        out_q.append(top)
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    out_q.append(d)
    return out_q, out_e


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B from the squares ``q`` of the diagonal and ``e`` of what stands above it."""
    found = []
    blocks = [(list(q), list(e), 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while q:
            if len(q) == 1:
                found.append(moved + q[0])
                break
            split = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _EPS * _EPS * (moved + q[i + 1]) or e[i] == 0), None)
            if split is not None:
                blocks.append((q[: split + 1], e[:split], moved))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            shift = _below_smallest(q, e) * (1 - 4 * len(q) * _EPS)
            step = _sweep(q, e, shift)
            while step is None:
                shift = shift / 2 if shift > moved * _EPS / 8 else 0.0
                step = _sweep(q, e, shift)
            (q, e), moved = step, moved + shift
    return sorted(found, reverse=True)


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> Iterator[np.ndarray]:
    """Unit vectors z with (B'B - value) z = gamma e_k, those of the smallest residual first."""
    n = len(q)
    low = np.sqrt(e / q[:-1]) if n > 1 else e
    s, p = np.empty(n), np.empty(n)
    down, up = np.empty(n), np.empty(n)
    tiny = _EPS * _EPS * max(float(q.max()), 1e-300)

    def safe(x: float) -> float:
        return x if abs(x) > tiny else np.copysign(tiny, x)

    s[0] = -value
    for i in range(n - 1):
        down[i] = q[i] * low[i] / safe(s[i] + q[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        ratio = q[i] / safe(q[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    for k in np.argsort(np.abs(gamma), kind="stable").tolist():
        z = np.zeros(n)
        z[k] = 1
        for i in range(k - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -up[i] * z[i]
        norm = np.linalg.norm(z)
        if np.isfinite(norm):
            yield z / norm


def _vectors(q: np.ndarray, e: np.ndarray, values: list[float]) -> list[np.ndarray]:
    """Orthogonal unit vectors for eigenvalues in falling order."""
    out: list[np.ndarray] = []
    for i, value in enumerate(values):
        near = [out[j] for j in range(i) if values[j] - value <= 1e-3 * values[j]]
        best, best_left = None, 0.0
        for z in _twisted(q, e, value):
            for _ in range(2):
                for other in near:
                    z = z - (other @ z) * other
            left = np.linalg.norm(z)
            if left > best_left:
                best, best_left = z / left, left
            if left > 0.5:
                break
        out.append(best)
    return out


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """``(values, directions, total)``: squared singular values of ``r`` in falling order, unit right vectors as columns, their sum."""
    scale = float(np.abs(r).max()) if r.size else 0.0
    if scale == 0:
        return np.zeros(0), np.zeros((r.shape[1], 0)), 0.0
    diagonal, above, p = bidiagonal(r / scale)
    q, e = diagonal**2, above**2
    total = float(q.sum() + e.sum())
    floor = _EPS**2 * float(max(q.max(), e.max(initial=0.0)))
    q = np.maximum(q, floor)
    cuts = [0, *(np.flatnonzero(e <= floor) + 1).tolist(), len(q)]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        values = dqds(q[a:b].tolist(), e[a : b - 1].tolist())
        vectors = _vectors(q[a:b], e[a : b - 1], values[:most])
        for value, z in zip(values, vectors):
            found.append((value, a, z))
    found.sort(key=lambda x: -x[0])
    found = [x for x in found[:most] if x[0] > NO_VARIANCE * found[0][0]]
    z = np.zeros((len(q), len(found)))
    for j, (_, a, part) in enumerate(found):
        z[a : a + len(part), j] = part
    # q and e stand for a matrix without negative entries; the signs of B belong to its vectors
    z *= np.concatenate([[1.0], np.cumprod(np.where(diagonal[:-1] * above < 0, -1.0, 1.0))])[:, None]
    return np.array([x[0] for x in found]) * scale**2, p @ z, total * scale**2


# Whitened rows

def _whiten(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Add ``whitened`` (an array) and the exact deviation to every row, in place of ``x``."""
    n, sums, map_ = model.value
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(a, BLOCK_ROWS)
            times = _times(_rows(block), n, sums)
            z = (times.astype(float) / n) @ map_
            small = times.dtype != object and times.size and int(np.abs(times).max()) ** 2 * times.shape[1] < 1 << 62
            exact = (times * times).sum(axis=1) if small else [sum(t * t for t in row) for row in times.astype(object).tolist()]
            digits = pa.array([str(int(x)) for x in exact], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32)), pa.array(z.ravel()))
            others = [block.column(c) for c in block.schema.names if c != "x"]
            yield pa.RecordBatch.from_arrays([*others, digits, lists], schema=pa.schema([*[f for f in block.schema if f.name != "x"], *schema]))


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sums and centred products of the whitened columns of a partition."""
    from pyspark import TaskContext

    n, mean, products = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            z = batch.column("whitened").flatten().to_numpy().reshape(batch.num_rows, -1)
            n, mean, products = _add(n, mean, products, len(z), z.mean(axis=0), (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)))
    if n:
        yield _packed(TaskContext.get().partitionId(), n, mean, products)


def _packed(part: int, n: int, mean: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()),
        "mean": pa.array([mean.tobytes()], pa.binary()), "products": pa.array([np.ascontiguousarray(products).tobytes()], pa.binary()),
    })


def _add(n: int, mean, products, m: int, other_mean: np.ndarray, other: np.ndarray):
    """Counts, means and centred products of two sets of rows together."""
    apart = other_mean - mean
    both = n + m
    return both, mean + apart * (m / both), products + other + np.outer(apart, apart) * (n * m / both)


def _add_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n, mean, products = None, 0, 0.0, 0.0
    for batch in batches:
        for row in batch.to_pylist():
            if part is not None and row["part"] != part:
                yield _packed(part, n, mean, products)
                n, mean, products = 0, 0.0, 0.0
            part = row["part"]
            other_mean = np.frombuffer(row["mean"])
            n, mean, products = _add(n, mean, products, row["n"], other_mean, np.frombuffer(row["products"]).reshape(len(other_mean), -1))
    if part is not None:
        yield _packed(part, n, mean, products)


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    kind = "part int, n long, mean binary, products binary"
    parts = written(whitened.select("whitened").mapInArrow(_scatter, kind), "whitening-products")
    left = parts.count()
    while left > 1:
        left = -(-left // FAN_IN)
        grouped = parts.withColumn("part", F.pmod("part", F.lit(left))).repartition(left, "part").sortWithinPartitions("part")
        parts = written(grouped.mapInArrow(_add_all, kind), "whitening-products")
        left = parts.count()
    one = parts.first()
    products = np.frombuffer(one["products"])
    k = int(round(len(products) ** 0.5))
    return float(np.abs(products.reshape(k, k) / one["n"] - np.eye(k)).max())


def whiten(rows: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """Rows that take part, without their vector, with ``whitened`` (an array, component 1 first), ``explained``
    (likewise), ``n``, ``deviation_exact`` and ``identity_error``.
    """
    added = ("x", "n", "whitened", "explained", "deviation_exact", "identity_error")
    rows = written(usable(rows.select(*[c for c in rows.columns if c == column or c.lower() not in added]), column), "whitening-rows")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    values, directions, total, n = np.zeros(0), np.zeros((1, 0)), 0.0, 0
    if sizes is not None:
        rows = rows.where(F.size("x") == sizes["d"])
        n, sums = totals(rows)
        values, directions, total = principal(triangular(rows, n, sums), most)
    names = [f for f in rows.schema if f.name != "x"]
    if not len(values):
        empty = rows.limit(0).drop("x").selectExpr("*", "CAST(NULL AS decimal(38,0)) AS deviation_exact", "CAST(NULL AS array<double>) AS whitened")
        return empty.selectExpr("*", "0L AS n", "CAST(NULL AS array<double>) AS explained", "0D AS identity_error")
    model = rows.sparkSession.sparkContext.broadcast((n, sums, directions / np.sqrt(values / n)))
    schema = pa.schema([("digits", pa.string()), ("whitened", pa.list_(pa.float64()))])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    done = rows.mapInArrow(partial(_whiten, model=model, schema=schema), f"{kept}, digits string, whitened array<double>")
    done = written(done.select(*[f"`{f.name}`" for f in names], F.expr("try_cast(digits AS decimal(38,0))").alias("deviation_exact"), "whitened"), "whitening-result")
    error = identity_error(done)
    return done.select("*", F.lit(n).cast("long").alias("n"), F.array(*[F.lit(float(v / total)) for v in values]).alias("explained"), F.lit(error).alias("identity_error"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    done = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = done.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_k", "_c"))
    return rows.select(
        "vec_id", (F.col("_k") + 1).alias("component"), "n", F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"),
        F.col("_c.whitened").alias("whitened"), F.col("_c.explained").alias("explained"), "identity_error", "deviation_exact",
    )
