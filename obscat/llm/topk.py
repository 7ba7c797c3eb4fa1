"""Exact top-k by inner product with block-at-a-time pruning.

Vectors become integers, floor(256 * x). Rows are dealt to segments by their dominant signed
component, so that rows of a segment look alike, and a segment is cut into blocks of rows. A block
keeps for every term (dimension) the largest and smallest value in it and its own forward index,
the rows' values. A query sums, over its terms, the largest product a block can give, visits the
blocks of a segment by falling bound, scores them through their forward index, and stops when a
bound falls below its k-th score. Equal bounds are still visited, since an equal score with a
smaller id wins.

A query group meets every segment through an equi-join on the segment number (no cross join, nothing broadcast);
what leaves a task is at most k rows per query and segment, which a grouped merge reduces to k.

Cases: a vector that is null, empty, or holds a null or non-finite component takes no part, nor
does a row with a null id. Shorter vectors count as padded with zeros. Ties go to the smaller id.
Rows that repeat an id are candidates each, never of a query with their id; a repeated query row
gives its result once. Components are held in 64-bit integers: a component of 2**31 or more
in size after scaling makes the query fail instead of giving a wrapped score; so 32 bits hold one between tasks. An empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obscat.llm.registry import query, table
from obscat.llm.store import written

#: Rows of a segment: one in ``SEGMENTS`` of all between these two numbers, so queries are sent to fewer segments of large tables.
SEGMENT_ROWS = 4096
MOST_SEGMENT_ROWS = 32_768
SEGMENTS = 64
BLOCK_ROWS = 64
GROUP_QUERIES = 512
#: Bytes of a packed segment or query group, and tasks that rows are dealt to by their order.
GROUP_BYTES = 16 << 20
PARTS = 512


def integer_vectors(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part, v as an array of long."""
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    small = F.forall("v", lambda x: F.abs(x) < (1 << 31))
    return (
        df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & good)
        .select(
            F.col(id_column).cast("long").alias("id"),
            F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"),
        )
        .select("id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("component too large")).cast("array<bigint>")).alias("v"))
    )


def _packed(rows: int):
    """Pack sorted rows ``(id, v)`` of a task to rows of bytes, each of at most ``rows`` of them and ``GROUP_BYTES``; ``at`` numbers them."""
    def group(ids: list[int], vectors: list[list[int]], width: int, at: int) -> pa.RecordBatch:
        matrix = np.zeros((len(vectors), width), np.int32)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        return pa.RecordBatch.from_pydict({
            "at": pa.array([at], pa.int64()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "m": pa.array([matrix.tobytes()], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, width, at = [], [], 0, 0
        for batch in batches:
            for one, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                wider = max(width, len(v))
                if ids and (len(ids) == rows or (len(ids) + 1) * wider * 4 > GROUP_BYTES):
                    yield group(ids, vectors, width, at)
                    ids, vectors, wider, at = [], [], len(v), at + 1
                ids.append(one)
                vectors.append(v)
                width = wider
        if ids:
            yield group(ids, vectors, width, at)

    return pack


def groups_of(df: DataFrame, order: list, total: int, rows: int) -> DataFrame:
    """``(part, at, ids, m)``: ``total`` rows dealt in ``order`` to groups of at most ``rows``.

    The driver sees a sample of the order for ``PARTS`` tasks at most, however many groups there are.
    """
    parts = min(max(1, -(-total // rows)), PARTS)
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "v")
    return dealt.mapInArrow(_packed(rows), "at long, ids binary, m binary").withColumn("part", F.spark_partition_id())


def numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """Written groups with a number in place of ``part`` and ``at``, from 0 without gaps, and how many there are."""
    sizes = {r[0]: r[1] + 1 for r in groups.groupBy("part").agg(F.max("at")).collect()}
    starts, n = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(n)
        n += sizes.get(part, 0)
    number = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("part")) + F.col("at")
    return groups.select(number.alias("segment"), "ids", "m"), n


def _score(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, qids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["qids"], np.int64)
                data = np.frombuffer(row["m"], np.int32).reshape(len(ids), -1)
                queries = np.frombuffer(row["qm"], np.int32).reshape(len(qids), -1)
                width = max(data.shape[1], queries.shape[1])
                data, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (data, queries))
                yield _search(ids, data, qids, queries, k)

    return search


def _number(data: np.ndarray, queries: np.ndarray) -> type:
    """Floats where they hold every sum of products exactly, else integers."""
    limit = float(np.abs(data).max()) * float(np.abs(queries).max()) * data.shape[1]
    if limit >= 2**63:
        raise OverflowError("scores need more than 64 bits")
    return np.float64 if limit < 2**53 else np.int64


def _search(ids, data, qids, queries, k) -> pa.RecordBatch:
    kind = _number(data, queries)
    data, queries = data.astype(kind), queries.astype(kind)
    cuts = np.arange(0, len(ids), BLOCK_ROWS)
    high = np.maximum.reduceat(data, cuts)
    low = np.minimum.reduceat(data, cuts)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    out_q, out_id, out_score = [], [], []
    order = np.argsort(-bounds, axis=1, kind="stable")
    for q in range(len(qids)):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, kind)
        for b in order[q]:
            if len(best) == k and bounds[q, b] < best[-1]:
                break
            part = slice(cuts[b], cuts[b] + BLOCK_ROWS)
            scores, here = data[part] @ queries[q], ids[part]
            keep = here != qids[q]
            if len(best) == k:
                keep &= scores >= best[-1]
            if not keep.any():
                continue
            best, best_ids = np.concatenate([best, scores[keep]]), np.concatenate([best_ids, here[keep]])
            first = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[first], best_ids[first]
        out_q.append(np.full(len(best), qids[q]))
        out_id.append(best_ids)
        out_score.append(best.astype(np.int64))
    return pa.RecordBatch.from_pydict({
        "query_id": np.concatenate(out_q).astype(np.int64),
        "vec_id": np.concatenate(out_id), "score": np.concatenate(out_score),
    })


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best of ``vectors`` for every query; both ``(id, v)``."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    at = F.array_position(F.transform("v", lambda x: F.abs(x)), largest)
    sided = vectors.withColumn("_at", at * F.signum(F.element_at("v", F.greatest(at, F.lit(1)).cast("int"))))
    total = vectors.count()
    rows = min(max(SEGMENT_ROWS, -(-total // SEGMENTS)), max(SEGMENT_ROWS, MOST_SEGMENT_ROWS))
    segments, n = numbered(written(groups_of(sided, [F.col("_at"), -largest, "id"], total, rows), "segments"))
    asked = queries.dropDuplicates(["id", "v"])
    groups = groups_of(asked, ["id"], queries.count(), GROUP_QUERIES).select(F.col("ids").alias("qids"), F.col("m").alias("qm"))
    # a merge join by its hint: Spark takes the exploded groups for as small as one copy of them, and would broadcast them
    spread = groups.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))).alias("segment"), "qids", "qm")
    found = spread.join(segments.hint("merge"), "segment").select("ids", "m", "qids", "qm") \
        .mapInArrow(_score(k), "query_id long, vec_id long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op6_topk", ORACLE)
def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every vector whose id is divisible by 50."""
    vectors = written(integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)
