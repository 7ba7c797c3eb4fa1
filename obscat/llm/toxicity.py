"""Toxicity: subword embeddings, averaged over a text, into a linear softmax.

A word is the bag of its character n-grams (``GRAMS`` long, the word's edges marked), each a bucket of
2^``BITS``; a text is the average of its words, where frequent words weigh less (a / (a + share of all
words)), and a word is the average of its n-grams' vectors. So a misspelling that was never seen
still shares most of its vectors with the word. Vectors and softmax are trained together by numpy
on the driver. Learned from is a sample of at most ``SAMPLE`` labelled documents with their whole texts, drawn by the
hash of the id; as it is small, its ids meet the documents without a shuffle of texts.

Over the sample Spark counts how many words of either class hold a bucket. Buckets that differ between
the classes more than any of them would by chance (``MIN_CHI``), at most ``MAX_FEATURES``, get vectors; the others would only be learned by
heart. As all but the softmax is linear, a task needs one number per bucket to score a text. All tables
that tasks get have a fixed size: 2^``BITS`` numbers for buckets and for word shares.

Cases: a null or empty text or one without words is scored by the bias alone; texts count whole; a
document with several labels is toxic if one says so; null labels say nothing, and a null id has none
and counts as held out; without any label every score is 0; repeated rows are scored as often as they
stand there. Result columns replace others of their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obscat.llm.arrays import _ROUND, ALNUM_WORD, mixed, pieces, runs, stretch_hashes, text_bytes
from obscat.llm.registry import query, table
from obscat.llm.store import written

GRAMS = (3, 4, 5, 6)
BITS = 18
#: Labelled documents that are learned from, at most.
SAMPLE = 12288
#: Buckets with a vector, at most.
MAX_FEATURES = 2048
#: Words that a bucket must stand in, and how far its classes must differ: one bucket in 2^18 does by chance.
MIN_WORDS = 5
MIN_CHI = 24.0
DIM = 16
#: Weight of words by their share of all words.
SHARE = 1e-4
RATE, EPOCHS, BATCH, DECAY = 0.05, 20, 256, 1e-3
#: Distinct words whose n-grams are spread out at once.
CHUNK_WORDS = 1 << 15


# Words and their n-grams

def _bag(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(row, word of every token, bytes, starts, ends, hashes)``; the last three of every distinct word."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    starts, ends = runs(data, offsets, ALNUM_WORD)
    row = np.searchsorted(offsets, starts, side="right") - 1
    hashes, first, word = np.unique(stretch_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return row, word, data, starts[first], ends[first], hashes


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first word, last word, word, bucket)`` of the n-grams of a chunk of words after another."""
    for a in range(0, len(starts), CHUNK_WORDS):
        low, high = starts[a : a + CHUNK_WORDS], ends[a : a + CHUNK_WORDS]
        sizes = high - low
        begin = np.cumsum(sizes + 2) - sizes - 2
        text = np.full(int((sizes + 2).sum()), ord("<"), np.uint8)
        text[begin + sizes + 1] = ord(">")
        inside = np.repeat(begin + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        text[inside] = data[np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        word = np.cumsum(points == ord("<")) - 1  # a word itself holds no edge mark
        words, buckets = [], []
        for n in GRAMS:
            m = len(points) - n + 1
            if m <= 0:
                continue
            whole = word[n - 1 :] == word[:m]
            value = np.full(m, n, np.uint64)
            for i in range(n):
                value += points[i : i + m] * _ROUND[i]
            words.append(word[:m][whole])
            buckets.append((mixed(value[whole]) >> np.uint64(64 - BITS)).astype(np.int64))
        yield a, a + len(low), np.concatenate(words), np.concatenate(buckets)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


# Counts over labelled texts

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of either class by bucket, occurrences by word slot, and words of either class in all (slot -1)."""
    found = np.zeros((2, 1 << BITS), np.int64)
    seen = np.zeros(1 << BITS, np.int64)
    total = np.zeros(2, np.int64)
    for batch in batches:
        for piece in pieces(batch, "text"):
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            row, word, data, starts, ends, hashes = _bag(piece.column("text"))
            if not len(row):
                continue
            seen += np.bincount(_slot(hashes), np.bincount(word, minlength=len(hashes)), 1 << BITS).astype(np.int64)
            once = np.unique(row * len(hashes) + word)
            of = np.stack([np.bincount((once % len(hashes))[toxic[once // len(hashes)] == c], minlength=len(hashes)) for c in (0, 1)])
            total += of.sum(axis=1)
            for a, b, words, buckets in _grams(data, starts, ends):
                pairs = np.unique(words * (1 << BITS) + buckets)
                for c in (0, 1):
                    found[c] += np.bincount(pairs & ((1 << BITS) - 1), of[c][a:b][pairs >> BITS], 1 << BITS).astype(np.int64)
    used = np.flatnonzero(found.sum(axis=0) + seen)
    yield pa.RecordBatch.from_pydict({
        "slot": np.append(used, -1), "n0": np.append(found[0][used], total[0]),
        "n1": np.append(found[1][used], total[1]), "n_seen": np.append(seen[used], 0),
    })


def _weights(seen: np.ndarray) -> np.ndarray:
    return (SHARE / (SHARE + seen / max(seen.sum(), 1))).astype(np.float32)


def choose(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """Buckets that get a vector, those that tell the classes apart best first."""
    a, b, c, d = (x.astype(float) for x in (n1, n0, all1 - n1, all0 - n0))
    apart = (a * d - b * c) ** 2 * max(all0 + all1, 1) / np.maximum((a + b) * (c + d) * max(all0, 1) * max(all1, 1), 1)
    apart[(n0 + n1 < MIN_WORDS) | (apart < MIN_CHI)] = -1
    best = np.argsort(-apart, kind="stable")[:MAX_FEATURES]
    return best[apart[best] > 0]


# Training

def _features(batches: Iterator[pa.RecordBatch], place: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Average of the chosen buckets of every text, as (feature, value) lists."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            row, word, data, starts, ends, hashes = _bag(piece.column("text"))
            out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int32), np.zeros(0, np.float32))] * piece.num_rows
            if len(row):
                width = len(hashes)
                pair, times = np.unique(row * width + word, return_counts=True)
                doc, token = pair // width, pair % width
                value = times * weight[_slot(hashes)][token]
                value /= np.bincount(doc, value, piece.num_rows)[doc]
                words, features, sizes = [], [], np.zeros(width)
                for a, b, w, buckets in _grams(data, starts, ends):
                    sizes[a:b] = np.bincount(w, minlength=b - a)
                    chosen = place[buckets] >= 0
                    words.append(w[chosen] + a)
                    features.append(place[buckets[chosen]])
                words, features = np.concatenate(words), np.concatenate(features)
                order = np.argsort(words, kind="stable")
                words, features = words[order], features[order]
                first = np.searchsorted(words, np.arange(width + 1))
                held = np.diff(first)[token]
                at = np.repeat(first[token], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                key = np.repeat(doc, held) * MAX_FEATURES + features[at]
                keys, inverse = np.unique(key, return_inverse=True)
                values = np.bincount(inverse, np.repeat(value / np.maximum(sizes[token], 1), held)) if len(key) else np.zeros(0)
                bounds = np.searchsorted(keys, np.arange(piece.num_rows + 1) * MAX_FEATURES)
                out = [((keys[i:j] % MAX_FEATURES).astype(np.int32), values[i:j].astype(np.float32)) for i, j in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_pydict({
                "place": piece.column("place"), "toxic": piece.column("toxic"),
                "features": pa.array([x[0] for x in out], pa.list_(pa.int32())),
                "values": pa.array([x[1] for x in out], pa.list_(pa.float32())),
            })


def train(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors and softmax from averaged features; returns what a feature adds to the log odds, and the bias."""
    rng = np.random.default_rng(12)
    scale = np.float32(1 / max(np.sqrt((x**2).sum(axis=1).mean()), 1e-12)) if x.size else np.float32(1)
    vectors = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    past = [np.full_like(p, 1e-8) for p in (vectors, softmax, bias)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rows = order[a : a + BATCH]
            bags = x[rows] * scale
            hidden = bags @ vectors
            scores = hidden @ softmax + bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            wrong = scores / scores.sum(axis=1, keepdims=True)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            steps = (bags.T @ (wrong @ softmax.T) + DECAY * vectors, hidden.T @ wrong + DECAY * softmax, wrong.sum(axis=0))
            for parameter, step, squares in zip((vectors, softmax, bias), steps, past):
                squares += step * step
                parameter -= RATE * step / np.sqrt(squares)
    return vectors @ (softmax[:, 1] - softmax[:, 0]) * scale, float(bias[1] - bias[0])


def labelled_texts(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(id, toxic, text)`` of at most ``sample`` documents ``(id, text)`` with a label ``(id, toxic)``, one row for an id."""
    labels = labels.where("toxic IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = labels.orderBy(F.xxhash64("id", F.lit(12)), "id").limit(sample)
    rows = documents.join(F.broadcast(drawn), "id").groupBy("id").agg(F.max(F.struct("toxic", "text")).alias("_r"))
    return written(rows.select("id", "_r.toxic", "_r.text"), "toxicity-labelled")


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    """``(log odds by bucket, weight by word slot, bias)`` from rows ``(id, toxic, text)`` with toxic 0 or 1."""
    counts = labelled.select("text", "toxic").mapInArrow(_count, "slot long, n0 long, n1 long, n_seen long")
    counts = counts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n_seen")]).toArrow()
    slot = counts.column("slot").to_numpy()
    if not len(slot):
        return None
    n0, n1, seen = np.zeros((3, 1 << BITS), np.int64)
    for array, name in ((n0, "n0"), (n1, "n1"), (seen, "n_seen")):
        array[slot[slot >= 0]] = counts.column(name).to_numpy()[slot >= 0]
    all0, all1 = (int(counts.column(name).to_numpy()[slot < 0].sum()) for name in ("n0", "n1"))
    chosen = choose(n0, n1, all0, all1)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    weight = _weights(seen)
    rows = labelled.select(F.xxhash64("id", F.lit(12)).alias("place"), "toxic", "text")
    bags = rows.mapInArrow(partial(_features, place=place, weight=weight), "place long, toxic int, features array<int>, values array<float>").toArrow()
    y = bags.column("toxic").to_numpy().astype(np.int64)
    if not len(y):
        return None
    x = np.zeros((len(y), max(len(chosen), 1)), np.float32)
    lists = bags.column("features").combine_chunks()
    row = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    x[row, lists.flatten().to_numpy()] = bags.column("values").combine_chunks().flatten().to_numpy()
    order = np.argsort(bags.column("place").to_numpy(), kind="stable")  # the rows come in any order
    log_odds, bias = train(x[order], y[order])
    by_bucket = np.zeros(1 << BITS, np.float32)
    by_bucket[chosen] = log_odds[: len(chosen)]
    return by_bucket, weight, bias


# Scores

def log_odds(column: pa.Array, by_bucket: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of the toxic class for every text of a column."""
    row, word, data, starts, ends, hashes = _bag(column)
    if not len(row):
        return np.full(len(column), bias)
    of_word = np.zeros(len(hashes))
    for a, b, words, buckets in _grams(data, starts, ends):
        of_word[a:b] = np.bincount(words, by_bucket[buckets], b - a) / np.maximum(np.bincount(words, minlength=b - a), 1)
    w = weight[_slot(hashes)].astype(float)
    total = np.bincount(row, w[word], len(column))
    return np.bincount(row, (w * of_word)[word], len(column)) / np.maximum(total, 1e-300) + bias


def _score(batches: Iterator[pa.RecordBatch], schema: pa.Schema, model) -> Iterator[pa.RecordBatch]:
    by_bucket, weight, bias = model.value
    for batch in batches:
        for piece in pieces(batch, "text"):
            score = 1 / (1 + np.exp(-np.clip(log_odds(piece.column("text"), by_bucket, weight, bias), -500, 500)))
            columns = [*piece.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*piece.schema, *schema]))


def score_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id") -> DataFrame:
    """Add ``score`` and ``predicted`` to documents with a ``text``; learned from ``labels`` ``(id, toxic)``."""
    documents = documents.select(*[c for c in documents.columns if c.lower() not in ("score", "predicted")])
    model = fit(labelled_texts(documents.select(F.col(id_column).alias("id"), "text"), labels, sample))
    if model is None:
        return documents.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    held = documents.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    schema = pa.schema([("score", pa.float64()), ("predicted", pa.int32())])
    return documents.mapInArrow(partial(_score, schema=schema, model=held), f"{fields}, score double, predicted int")


#: Fixed value of the contract: rows whose remainder is 0 are never learned from.
FOLDS = 5


def held_out():
    """True where a row's label may not be learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@query("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").where(~held_out()).select(F.col("doc_id").alias("id"), "toxic")
    return score_toxicity(documents, labels).drop("text")
