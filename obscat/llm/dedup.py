"""Near-duplicate detection: tensored MinHash banding, exact checks, connected components.

A text's set is its distinct word shingles, as 64-bit hashes. Texts with equal sets form a class at
once, through two sums over the set (128 bits), and only its smallest id goes on. The minimum
hashes form two collections of ``rows`` compound hashes; a table key is a pair with one of either,
so ``rows`` squared tables need only ``2 * rows * width`` minimum hashes. A pair of similarity s
shares a table with probability (1 - (1 - s**width)**rows)**2.

A second sketch tells which pairs of a table can be similar at all: one permutation in ``BINS`` bins,
four bits of the smallest hash of each. Where a set has fewer shingles than bins, little is lost of it,
so the estimate is close; pairs more than ``SIGMAS`` standard deviations below the limit are left out.

No bucket is expanded to all pairs. First every member of a bucket is compared with one member,
chosen by one of ``ORDERS`` orders; the links found give components. Only buckets whose members are
still in different components are looked at further: their rows meet in blocks of bounded size, and
a task looks at those pairs of different components whose sketches agree enough, each
pair in the first table it shares only, so no pair of a bucket goes unseen. Members with at most
``WHOLE`` shingles bring their full sets along: the task settles their pairs itself, gives out links
only and joins their components at once, so a block gives out fewer links than it has components,
however many pairs are close to the limit. Pairs with a larger set are given out where their
components are still apart. All pairs given out are checked on the full sets of their texts.

Components come from alternating hooking on the smallest neighbour and pointer jumping over
written tables; links never reach the driver.

Cases: a null text or one without words has an empty set, is linked with nothing and is kept;
a text with fewer words than a shingle has its whole sequence as one shingle. Repeated rows with one id are
one class and come out as often as they stand there. Rows with a null id are left out of links and
come out with a null component, kept. An empty table gives an empty result. Other columns are
carried; those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm.arrays import mixed, pieces, shingles, stretch_hashes, words
from obscat.llm.bitmaps import bitmap, may_hold
from obscat.llm.registry import query, table
from obscat.llm.store import written

#: Minimum hashes per compound hash.
WIDTH = 2
#: Orders by which a bucket chooses the member that all others are compared with.
ORDERS = 3
#: Bins of the second sketch, and how far below the limit an estimate may lie.
BINS = 1024
SIGMAS = 4.0
#: Members of a block, and pairs that a task looks at in one go.
BLOCK = 512
PAIRS_AT_ONCE = 1 << 20
#: Shingles of the largest set that goes along with a member of a block.
WHOLE = 512
_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, bounds)``: the sorted distinct shingles of every text."""
    data, starts, ends, first = words(column)
    values, bounds = shingles(stretch_hashes(data, starts, ends), first, k)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(bounds) - 1))])


def binned(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketch of sorted sets laid end to end: four bits of the smallest value of every bin, 0 for an empty bin."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell = row * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = cell[1:] != cell[:-1]
    out = np.zeros(len(sizes) * BINS, np.uint8)
    out[cell[first]] = (mixed(values[first]) % np.uint64(15) + np.uint64(1)).astype(np.uint8)
    out = out.reshape(len(sizes), BINS)
    return out[:, 0::2] | out[:, 1::2] << 4


def may_be_similar(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these sketches and sizes can be similar enough.

    The variance of the estimate is that of sampling the union's bins without replacement.
    """
    limit = percent / 100
    used = ((a > 0) | (b > 0)).sum(axis=1)
    agree = ((a == b) & (a > 0)).sum(axis=1)
    union = np.maximum((na + nb) / (1 + limit), 2.0)
    spread = np.maximum((1 + 1 / (union - 1)) / np.maximum(used, 1) - 1 / (union - 1), 0.0)
    slack = SIGMAS * np.sqrt(limit * (1 - limit) * spread) + 0.5 / np.maximum(used, 1)
    sizes = (100 * na >= percent * nb) & (100 * nb >= percent * na)
    return sizes & (agree >= (limit - slack) * used)


def _signatures(k: int, rows: int):
    hashes = 2 * rows * WIDTH
    schema = {"a": pa.int64(), "b": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                values, bounds = shingle_sets(piece.column("text"), k)
                sizes = np.diff(bounds)
                some = sizes > 0
                at = bounds[:-1][some]
                sums = np.zeros((2, len(piece)), np.uint64)
                mins = np.zeros((len(piece), hashes), np.uint64)
                if len(values):
                    sums[0, some] = np.add.reduceat(values, at)
                    sums[1, some] = np.add.reduceat(mixed(values ^ _SEEDS[0, 63]), at)
                    for i in range(hashes):
                        mins[some, i] = np.minimum.reduceat(values * _SEEDS[0, i] + _SEEDS[1, i], at)
                # 32 bits of a minimum tell two of them apart well enough to choose candidates
                packed = pa.array([m.tobytes() for m in (mins >> np.uint64(32)).astype(np.uint32)], pa.binary())
                bins = pa.array([m.tobytes() for m in binned(values, sizes)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("kept"), *(pa.array(x.view(np.int64)) for x in sums), pa.array(sizes.astype(np.int64)), packed, bins],
                    names=["kept", *schema, "mins", "bins"])

    return run


def _compound(mins: np.ndarray) -> np.ndarray:
    """Both collections of compound hashes: shape (texts, 2, rows)."""
    out = np.zeros(mins.shape[:3], np.uint64)
    for w in range(WIDTH):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + mins[..., w])
    return out


def _key(a: np.ndarray, b: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mixed(a * _SEEDS[0, 62] + b + number.astype(np.uint64) * _SEEDS[0, 61])


def _unpacked(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, 2, rows, WIDTH)


def _table_keys(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            compound = _compound(_unpacked(batch.column("mins"), rows))
            number = np.arange(rows * rows).reshape(rows, rows)
            keys = _key(compound[:, 0, :, None], compound[:, 1, None, :], number)
            ids = np.repeat(batch.column("id").to_numpy(), rows * rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return run


def _rows_of_bins(column: pa.Array) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS // 2)
    out = np.empty((len(packed), BINS), np.uint8)
    out[:, 0::2], out[:, 1::2] = packed & 15, packed >> 4
    return out


def _agreement(percent: int):
    """Keep pairs whose sketches agree enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = may_be_similar(*(_rows_of_bins(batch.column(c)) for c in ("ba", "bb")), *(batch.column(c).to_numpy() for c in ("na", "nb")), percent)
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    return run


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets are similar enough."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common) and common > 0


def _similar(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "tx"):
                for part in pieces(piece, "ty"):
                    (vx, bx), (vy, by) = (shingle_sets(part.column(c), k) for c in ("tx", "ty"))
                    keep = [alike(vx[bx[i] : bx[i + 1]], vy[by[i] : by[i + 1]], percent) for i in range(len(part))]
                    yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def likely_pairs(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(x, y)`` that their signatures ``(id, n, bins)`` don't rule out."""
    sig = lambda i, n, m: signatures.select(F.col("id").alias(i), F.col("n").alias(n), F.col("bins").alias(m)).hint("merge")
    return pairs.join(sig("x", "na", "ba"), "x").join(sig("y", "nb", "bb"), "y").select("x", "y", "na", "nb", "ba", "bb") \
        .mapInArrow(_agreement(percent), "x long, y long")


def _possible(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["id", "text"]).filter(pa.array(may_hold(bits.value, batch.column("h").to_numpy().view(np.uint64))))

    return run


def _texts_of(needed: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ids are in ``needed``.

    A bitmap of fixed size leaves most of the others out before the shuffle; the join decides.
    """
    bits = needed.sparkSession.sparkContext.broadcast(bitmap(needed.select(F.xxhash64("id").alias("h")), "h"))
    near = texts.withColumn("h", F.xxhash64("id")).mapInArrow(_possible(bits), "id long, text string")
    return near.join(needed.hint("merge"), "id", "left_semi")


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                values, bounds = shingle_sets(piece.column("text"), k)
                sizes = np.diff(bounds)
                sets = [values[a:b].tobytes() if b - a <= WHOLE else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sizes.astype(np.int64)), pa.array(sets, pa.binary())], names=["id", "n", "whole"])

    return run


def whole_sets(ids: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``(id, n, whole)``: the sets of the texts of ``ids``, empty for those of more than ``WHOLE`` shingles."""
    return _texts_of(ids, texts).mapInArrow(_whole_sets(k), "id long, n long, whole binary").distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(x, y)`` whose full sets are similar enough; ``texts`` is ``(id, text)``."""
    used = _texts_of(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), texts)
    text = lambda i, t: used.select(F.col("id").alias(i), F.col("text").alias(t)).hint("merge")
    return pairs.join(text("x", "tx"), "x").join(text("y", "ty"), "y").select("x", "y", "tx", "ty") \
        .mapInArrow(_similar(k, percent), "x long, y long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every end of the edges ``(x, y)``; root is the smallest id reachable.

    In every round a node takes the smallest root among its own, its neighbours' and its root's,
    and tells its root what its neighbours know; a chain of n links takes about log n rounds.
    """
    both = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("root")).select(F.col("x").alias("id"), "root"), "labels")
    while True:
        of = lambda c, r: label.select(F.col("id").alias(c), F.col("root").alias(r))
        near = both.join(of("y", "other").hint("merge"), "y").groupBy("x").agg(F.min("other").alias("other"))
        known = near.join(of("x", "root").hint("merge"), "x").join(of("root", "above").hint("merge"), "root")
        least = F.least("root", "other", "above")
        told = known.select(F.explode(F.array("x", "root")).alias("id"), least.alias("new"))
        best = told.groupBy("id").agg(F.min("new").alias("new"))
        after = written(best.join(label.hint("merge"), "id").select("id", F.col("new").alias("root"), F.col("root").alias("before")), "labels")
        label = after.select("id", "root")
        if after.where("root <> before").isEmpty():
            return label


def _joining(left: np.ndarray, right: np.ndarray, root: np.ndarray, whole: list[bytes], above: dict[int, int], percent: int) -> np.ndarray:
    """Which pairs to give out: links that join components, and pairs without full sets of components still apart.

    ``above`` tells of a component which one it was joined to.
    """
    def top(r: int) -> int:
        while (up := above.get(r)) is not None:
            above[r] = above.get(up, up)
            r = up
        return r

    root = root.tolist()
    sets = [np.frombuffer(w, np.uint64) for w in whole]
    out, later = [], []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        if not len(sets[a]) or not len(sets[b]):
            later.append((i, root[a], root[b]))
            continue
        ra, rb = top(root[a]), top(root[b])
        if ra != rb and alike(sets[a], sets[b], percent):
            above[ra] = rb
            out.append(i)
    out.extend(i for i, a, b in later if top(a) != top(b))
    return np.array(out, np.int64)


def _pairs_in_groups(rows: int, percent: int, full: bool = False):
    """Likely pairs of different components from rows sorted by group ``(key, lo, hi)``; ``full`` where rows have full sets."""
    above: dict[int, int] = {}

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        whole = t.column("whole").to_pylist() if full else []
        key, lo, hi, own, ids, n, root = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "id", "n", "root"))
        compound, bins = _compound(_unpacked(t.column("mins"), rows)), _rows_of_bins(t.column("bins"))
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        before = np.arange(len(ids)) - start
        total = np.concatenate([[0], np.cumsum(before)])
        done = 0
        while done < len(ids):
            stop = max(done + 1, int(np.searchsorted(total, total[done] + PAIRS_AT_ONCE, side="right")) - 1)
            left = np.repeat(np.arange(done, stop), before[done:stop])
            right = start[left] + np.arange(len(left)) - (total[left] - total[done])
            done = stop
            fit = (root[left] != root[right]) & ((lo[left] == hi[left]) | (own[left] != own[right])) & (ids[left] != ids[right])
            fit &= (100 * n[left] >= percent * n[right]) & (100 * n[right] >= percent * n[left])
            left, right = left[fit], right[fit]
            same = compound[left] == compound[right]
            a, b = same[:, 0].argmax(axis=1), same[:, 1].argmax(axis=1)
            first = _key(compound[left, 0, a], compound[left, 1, b], a * rows + b).view(np.int64) == key[left]
            left, right = left[first], right[first]
            fit = np.concatenate([np.zeros(0, bool), *(
                may_be_similar(bins[left[i : i + 8192]], bins[right[i : i + 8192]], n[left[i : i + 8192]], n[right[i : i + 8192]], percent) for i in range(0, len(left), 8192))])
            left, right = left[fit], right[fit]
            if full:
                go = _joining(left, right, root, whole, above, percent)
                left, right = left[go], right[go]
            x, y = ids[left], ids[right]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("key", "lo", "hi")
            last = [batch.column(c)[-1].as_py() for c in names]
            tail = np.ones(batch.num_rows, bool)
            for c, v in zip(names, last):
                tail &= batch.column(c).to_numpy() == v
            cut = int(np.argmax(tail))
            if cut:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif held and all(held[-1].column(c)[-1].as_py() == v for c, v in zip(names, last)):
                held.append(batch)
            else:
                if held:
                    yield from pairs(pa.Table.from_batches(held))
                held = [batch]
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def split_members(members: DataFrame) -> DataFrame:
    """The members ``(key, id, n, root)`` of buckets that hold several components, with the number of their blocks."""
    split = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    return members.join(split.select("key", blocks.alias("blocks")).hint("merge"), "key").select("key", "id", "n", "root", "blocks")


def unlinked_pairs(members: DataFrame, signatures: DataFrame, percent: int, rows: int) -> DataFrame:
    """Likely pairs ``(x, y)`` of buckets that hold several components; ``members`` is ``(key, id, n, root)``.

    A bucket of more than ``BLOCK`` members is cut into blocks by a hash, and every two blocks meet.
    """
    return block_pairs(split_members(members), signatures, percent, rows)


def block_pairs(split: DataFrame, signatures: DataFrame, percent: int, rows: int) -> DataFrame:
    """Likely pairs ``(x, y)`` of different components; where ``signatures`` has full sets, only those that can join some."""
    rest = split.select("key", "id", "n", "root", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    full = [c for c in signatures.columns if c == "whole"]
    return (
        rest.join(signatures.select("id", "n", "mins", "bins", *full).hint("merge"), ["id", "n"])
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "root", "mins", "bins", *full)
        .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        .mapInArrow(_pairs_in_groups(rows, percent, bool(full)), "x long, y long")
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_shingles, component_id, kept`` to ``docs`` and drop the text.

    Texts are linked from ``percent`` per cent of shared shingles on; ``rows`` compound hashes of
    either collection give ``rows`` squared tables.
    """
    result = ("n_shingles", "component_id", "kept")
    others = [c for c in docs.columns if c not in (text, id_column) and c.lower() not in result]
    rows_in = docs.select(F.struct(docs[id_column].alias("id"), *[docs[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("kept"), docs[text].cast("string").alias("text"))
    kind = rows_in.schema["kept"].dataType.simpleString()
    signed = written(rows_in.mapInArrow(_signatures(k, rows), f"kept {kind}, a long, b long, n long, mins binary, bins binary"), "signatures")
    sets = signed.select(F.col("kept.id").cast("long").alias("id"), "a", "b", "n", "mins", "bins").where("id IS NOT NULL AND n > 0")
    classes = sets.groupBy("a", "b", "n").agg(F.min("id").alias("rep"), F.any_value("mins").alias("mins"), F.any_value("bins").alias("bins"))
    classes = written(classes, "classes")
    reps = classes.select(F.col("rep").alias("id"), "n", "mins", "bins")
    # an id with several texts has one class per text: its links are found for each of them
    signatures = reps
    keyed = written(reps.select("id", "mins").mapInArrow(_table_keys(rows), "key long, id long"), "keys")
    pick = F.struct(F.xxhash64("id", F.pmod("key", F.lit(ORDERS))).alias("h"), "id")
    buckets = keyed.groupBy("key").agg(F.min(pick)["id"].alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "centre")
    members = written(keyed.join(buckets.hint("merge"), "key"), "members")
    stars = members.where("id <> centre").select(F.least("id", "centre").alias("x"), F.greatest("id", "centre").alias("y")).distinct()
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text].cast("string").alias("text")).where("id IS NOT NULL")
    asked = written(likely_pairs(stars, signatures, percent).distinct(), "pairs")
    links = written(similar_pairs(asked, texts, k, percent), "links")
    found = components(links)
    sizes = reps.select("id", "n").dropDuplicates()
    rooted = members.select("key", "id").join(sizes.hint("merge"), "id").join(found.hint("merge"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    split = written(split_members(rooted), "split")
    sets_too = signatures.join(whole_sets(split.select("id").distinct(), texts, k).hint("merge"), ["id", "n"])
    rest = written(block_pairs(split, sets_too, percent, rows).distinct().join(asked.hint("merge"), ["x", "y"], "left_anti"), "pairs")
    more = similar_pairs(rest, texts, k, percent)
    root = lambda c, r: found.select(F.col("id").alias(c), F.col("root").alias(r))
    merges = more.join(root("x", "rx").hint("merge"), "x", "left").join(root("y", "ry").hint("merge"), "y", "left").select(F.coalesce("rx", "x").alias("x"), F.coalesce("ry", "y").alias("y"))
    rooted = classes.join(found.hint("merge"), classes["rep"] == found["id"], "left").select("a", "b", "n", F.coalesce("root", "rep").alias("root"))
    # ids that repeat with different texts tie the components of those texts together
    shared = sets.select("id", "a", "b", "n").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("id")
    home = sets.join(shared.hint("merge"), "id", "left_semi").join(rooted.hint("merge"), ["a", "b", "n"]).groupBy("id").agg(F.collect_set("root").alias("roots")).where(F.size("roots") > 1)
    ties = home.select(F.array_min("roots").alias("x"), F.explode("roots").alias("y"))
    joins = written(merges.unionByName(ties).where("x <> y").distinct(), "joins")
    if not joins.isEmpty():
        top = components(joins).select(F.col("id").alias("root"), F.col("root").alias("top"))
        rooted = rooted.join(top.hint("merge"), "root", "left").select("a", "b", "n", F.coalesce("top", "root").alias("root"))
    out = signed.join(rooted.hint("merge"), ["a", "b", "n"], "left")
    own = F.col("kept.id").cast("long")
    component = F.coalesce("root", own)
    return out.select(
        F.col("kept.id").alias(id_column), *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(others)],
        F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == own, F.lit(True)).alias("kept"),
    )


@query("op5_dedup")
def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 per cent of their three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=85, rows=7)
