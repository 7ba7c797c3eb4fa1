"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item, windows of its number of words are laid over all documents. The
fingerprint of a window is the SimHash of its word shingles, each weighted by how often it stands
there. Fingerprints within ``RADIUS`` bits of an item's are found with a multi-index: the 64 bits
are cut into ``BLOCKS`` blocks, two fingerprints within the radius agree in one block but for
RADIUS // BLOCKS bits, so an item is listed under all values of a block that near, and an equi-join
on item length, block and value finds every pair within the radius. Candidates are then checked
exactly: weighted similarity of the shingles, sum of smaller counts over sum of larger counts.

Only windows that can reach the similarity get a fingerprint: of m shingles, 2 s / (1 + s) * m must
be shingles of the benchmark. A bitmap of fixed size, built from all items, tells which words may
start one. This leaves out no window that the check would accept. Every stretch of a document with
such windows is one row with its word hashes; different fingerprints are matched once, however
often they stand in the corpus.

Cases: a null or empty text or item matches nothing. An item with fewer words than a shingle is one
shingle, its whole sequence. An item that repeats matches under each of its ids; a null item id is
kept as null. Repeated documents give one row per id and item. Per document and item the best window counts,
of equals the first. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obscat.llm.arrays import pieces, rows_of, runs, sequence_hash, stretch_hashes, words
from obscat.llm.bitmaps import bitmap, may_hold
from obscat.llm.registry import query, table
from obscat.llm.store import written

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
BLOCKS = 4
RADIUS = 15
_STRUCT = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("fp", pa.int64())]))


def simhash(shingle_rows: np.ndarray) -> np.ndarray:
    """Fingerprint of every row of shingle hashes; a shingle counts as often as it stands there."""
    bits = np.unpackbits(np.ascontiguousarray(shingle_rows).view(np.uint8).reshape(*shingle_rows.shape, 8), axis=2)
    ones = bits.sum(axis=1, dtype=np.int32)
    return np.packbits(2 * ones > shingle_rows.shape[1], axis=1).view(np.uint64).ravel()


def windows_of(hashes: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows of ``size`` words at ``starts``."""
    width = min(SHINGLE, size)
    together = sequence_hash(hashes, width)
    m = size - width + 1
    out = [np.zeros(0, np.uint64)]
    step = max(1, (1 << 20) // (m * BITS))
    for i in range(0, len(starts), step):
        out.append(simhash(together[starts[i : i + step, None] + np.arange(m)]))
    return np.concatenate(out)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            data, starts, ends, first = words(piece.column("text"))
            hashes = stretch_hashes(data, starts, ends)
            for i in range(len(piece)):
                own = hashes[first[i] : first[i + 1]]
                if len(own):
                    width = min(SHINGLE, len(own))
                    yield pa.RecordBatch.from_arrays([
                        piece.column("item_id")[i : i + 1], pa.array([len(own)], pa.int64()),
                        pa.array(windows_of(own, len(own), np.zeros(1, np.int64)).view(np.int64)),
                        pa.array([own.view(np.int64)], pa.list_(pa.int64())),
                        pa.array([sequence_hash(own, width).view(np.int64)], pa.list_(pa.int64())),
                    ], names=["item_id", "size", "fp", "words", "shingles"])


def possible_starts(hits: np.ndarray, row: np.ndarray, m: int, need: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Starts of windows of ``m`` shingles of which at least ``need`` are among ``hits`` (sorted places)."""
    if len(hits) < need:
        return np.zeros(0, np.int64)
    a, b = hits[: len(hits) - need + 1], hits[need - 1 :]
    near = (b - a < m) & (row[: len(a)] == row[need - 1 :])
    a, b = a[near], b[near]
    low = np.maximum(b - m + 1, first[near])
    high = np.minimum(a, last[near] - m)
    fits = low <= high
    low, high = low[fits], high[fits]
    if not len(low):
        return np.zeros(0, np.int64)
    sizes = high - low + 1
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.unique(np.repeat(low, sizes) + inside)


def _stretches(bits, sizes: list[int], similarity: float):
    """Stretches of documents with windows that can be similar to an item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = _scan(piece, bits.value, sizes, similarity)
                if found is not None:
                    yield found

    return run


def _scan(piece: pa.RecordBatch, bits: np.ndarray, sizes: list[int], similarity: float) -> pa.RecordBatch | None:
    data, starts, ends, first = words(piece.column("text"))
    hashes = stretch_hashes(data, starts, ends)
    found_at, found_size, found_fp = [], [], []
    row_of_word = np.repeat(np.arange(len(piece)), np.diff(first))
    for width in sorted({min(SHINGLE, s) for s in sizes}):
        together = sequence_hash(hashes, width)
        hits = np.flatnonzero(may_hold(bits, together))
        row = row_of_word[hits]
        inside = hits + width <= first[row + 1]
        hits, row = hits[inside], row[inside]
        if not len(hits):
            continue
        for size in (s for s in sizes if min(SHINGLE, s) == width):
            m = size - width + 1
            need = max(1, int(np.ceil(2 * similarity / (1 + similarity) * m - 1e-9)))
            k = max(0, len(hits) - need + 1)
            at = possible_starts(hits, row, m, need, first[row[:k]], first[row[:k] + 1] - width + 1)
            if len(at):
                found_at.append(at)
                found_size.append(np.full(len(at), size))
                found_fp.append(windows_of(hashes, size, at))
    if not found_at:
        return None
    at, size, fp = map(np.concatenate, (found_at, found_size, found_fp))
    # windows that overlap or touch make one stretch
    mark = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + size, -1)
    covered = (np.cumsum(mark[:-1]) > 0).astype(np.uint8)
    a, b = runs(covered, first, np.array([False, True] + [False] * 254))
    own = np.searchsorted(a, at, side="right") - 1
    order = np.lexsort((at, own))
    at, size, fp, own = at[order], size[order], fp[order], own[order]
    cut = np.searchsorted(own, np.arange(len(a) + 1))
    row = row_of_word[a]
    flat = pa.StructArray.from_arrays([pa.array(at - a[own]), pa.array(size), pa.array(fp.view(np.int64))], fields=list(_STRUCT.value_type))
    lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), flat)
    return pa.RecordBatch.from_arrays([
        piece.column("kept").take(pa.array(row)), pa.array(a - first[row]),
        pa.array([hashes[x:y].view(np.int64) for x, y in zip(a, b)], pa.list_(pa.int64())), lists,
    ], names=["kept", "offset", "words", "windows"])


def near_masks(width: int, errors: int) -> list[int]:
    """All values of ``width`` bits with at most ``errors`` bits set."""
    return [sum(1 << b for b in bits) for n in range(errors + 1) for bits in combinations(range(width), n)]


def within_radius(fingerprints: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``(size, fp, item)`` of fingerprints ``(size, fp)`` and items ``(item, size, item_fp)`` within the radius."""
    width = BITS // BLOCKS
    block = lambda c, i: F.shiftrightunsigned(c, width * i).bitwiseAND((1 << width) - 1)
    masks = F.array(*[F.lit(m) for m in near_masks(width, RADIUS // BLOCKS)])
    blocks = lambda c: F.posexplode(F.array(*[block(c, i) for i in range(BLOCKS)])).alias("block", "value")
    listed = items.select("item", "size", "item_fp", blocks("item_fp")).select("item", "size", "item_fp", "block", "value", F.explode(masks).alias("mask")) \
        .select("item", "size", "item_fp", "block", F.col("value").bitwiseXOR(F.col("mask").cast("long")).alias("value"))
    asked = fingerprints.select("size", "fp", blocks("fp"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    return asked.join(listed.hint("merge"), ["size", "block", "value"]).where(distance <= RADIUS).select("size", "fp", "item").distinct()


def _exact(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            for i, row in enumerate(batch.select(["words", "start", "size", "item_words"]).to_pylist()):
                width = min(SHINGLE, row["size"])
                x, y = (sequence_hash(np.array(w, np.int64).view(np.uint64), width) for w in (row["words"][row["start"] : row["start"] + row["size"]], row["item_words"]))
                (u, n), (v, k) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
                _, a, b = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                both = int(np.minimum(n[a], k[b]).sum())
                value = both / (len(x) + len(y) - both)
                if value >= similarity:
                    keep.append(i)
                    values.append(value)
            some = batch.select(["kept", "row", "item", "first", "size"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(values, pa.float64())], names=["kept", "row", "item", "first", "size", "similarity"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, start_word, end_word, similarity)``: items that documents hold, with the best window."""
    spark = docs.sparkSession
    rows = benchmark.select(benchmark[item_id].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text"))
    items = written(
        rows.mapInArrow(_items, "item_id long, size long, fp long, words array<long>, shingles array<long>")
        .withColumn("item", F.monotonically_increasing_id()), "items")
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").toLocalIterator()]
    bits = spark.sparkContext.broadcast(bitmap(items.select(F.explode("shingles").alias("h")), "h"))
    inner = docs.select(F.struct(docs[id_column].alias("id")).alias("kept"), docs[text].cast("string").alias("text"))
    kind = inner.schema["kept"].dataType.simpleString()
    stretches = written(
        inner.mapInArrow(_stretches(bits, sizes, similarity), f"kept {kind}, offset long, words array<long>, windows array<struct<start:bigint,size:bigint,fp:bigint>>")
        .withColumn("row", F.monotonically_increasing_id()), "stretches")
    windows = stretches.select("row", F.explode("windows").alias("w")).select("row", "w.start", "w.size", "w.fp")
    fingerprints = windows.select("size", "fp").distinct()
    near = within_radius(fingerprints, items.select("item", "size", F.col("fp").alias("item_fp")))
    # no join of rows of documents is a broadcast one: Spark sizes exploded windows far too low for it
    candidates = windows.join(near.hint("merge"), ["size", "fp"]).select("row", "start", "size", "item")
    whole = candidates.join(stretches.select("row", "kept", "offset", "words").hint("merge"), "row").join(items.select("item", F.col("words").alias("item_words")), "item")
    exact = whole.select("kept", "row", "item", (F.col("offset") + F.col("start")).alias("first"), "start", "size", "words", "item_words") \
        .mapInArrow(_exact(similarity), f"kept {kind}, row long, item long, first long, size long, similarity double")
    best = exact.groupBy("kept", "item").agg(F.max(F.struct("similarity", (-F.col("first")).alias("back"), "size")).alias("b"))
    return best.join(items.select("item", "item_id"), "item").select(
        F.col("kept.id").alias(id_column), "item_id", (-F.col("b.back")).alias("start_word"),
        (F.col("b.size") - F.col("b.back")).alias("end_word"), F.col("b.similarity").alias("similarity"),
    )


@query("op1_decontam")
def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
