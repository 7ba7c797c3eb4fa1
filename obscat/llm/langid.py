"""Language identification by character models with interpolated Kneser-Ney smoothing.

Training counts character trigrams of lower-cased words, padded by one blank on both sides, per
language. Tasks count distinct words first, so a frequent word is cut up once per piece of text,
and sum trigrams before the shuffle. Continuation counts, context totals and the discounts
n1 / (n1 + 2 n2) are grouped in Spark. The model is keyed by a one-to-one hash of the packed n-gram,
so no two n-grams share an entry. Tasks hold the logarithms of the most frequent trigrams, at most
``HOT``; every other trigram of a text leaves the task with its count in that text, and a join with the
sharded model adds its share. ``HOT`` bounds what a task holds and changes no result.

A document's cross-entropy per character decides; lower is better. The score is the winner's
share after a softmax over the differences of the mean logarithms, scaled by ``SHARPNESS``. A
language's rejection limit is a high quantile of the cross-entropies of its own training texts;
``rejected`` marks what lies above, the prediction stays.

Cases: a null text or one without a letter is ``und`` with score 0; texts count whole, however
long; equal cross-entropies go to the language that sorts first; repeated rows count and are
predicted as often as they stand there. Without training rows everything is ``und``. The
predicted columns replace others of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obscat.llm.arrays import pieces, stretch_hashes, text_bytes
from obscat.llm.registry import query, table
from obscat.llm.store import written

#: Most trigrams that tasks hold.
HOT = 1 << 18
SHARPNESS = 8.0
CHAR = 21
FLUSH = 500_000
CHARS_BYTES = 1 << 20

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Flag per code point that is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def distinct_words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """``(code points, starts, ends, row, word, times)`` of the distinct words of each row.

    ``starts`` and ``ends`` are those of the distinct words of all rows in the code points; every
    entry of ``row, word, times`` says how often a word stands in a row.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    mask = np.concatenate([[False], letter_table()[points], [False]])
    edge = np.flatnonzero(mask[1:] != mask[:-1])
    starts, ends = edge[0::2], edge[1::2]
    hashes = stretch_hashes(points, starts, ends)
    _, at, word = np.unique(hashes, return_index=True, return_inverse=True)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    pair, times = np.unique(rows * np.int64(max(1, len(at))) + word, return_counts=True)
    return points, starts[at], ends[at], pair // max(1, len(at)), pair % max(1, len(at)), times


def word_trigrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(trigram, word)``: the packed trigrams of padded words, one per letter and one for the end."""
    sizes = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(first[-1]) - first[word]
    chars = np.where((inside == 0) | (inside == sizes[word] - 1), 32, points[np.clip(starts[word] + inside - 1, 0, max(0, len(points) - 1))]) if len(points) else np.zeros(0)
    chars = chars.astype(np.uint64)
    previous = np.concatenate([[32], chars[:-1]]).astype(np.uint64)
    before = np.concatenate([[32, 32], chars[:-2]]).astype(np.uint64)[: len(chars)]
    before = np.where(inside == 1, 32, before)
    grams = before << np.uint64(2 * CHAR) | previous << np.uint64(CHAR) | chars
    keep = inside > 0
    return grams[keep], word[keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.astype(np.int64), "n": counts})
        sums.clear()

    for batch in batches:
        for piece in pieces(batch, "text", CHARS_BYTES):
            langs = np.array(piece.column("lang").to_pylist(), object)
            points, starts, ends, row, word, times = distinct_words([t or "" for t in piece.column("text").to_pylist()])
            if not len(starts):
                continue
            grams, of = word_trigrams(points, starts, ends)
            for lang in sorted(set(langs)):
                weight = np.bincount(word, times * (langs[row] == lang), len(starts)).astype(np.int64)
                used = weight[of] > 0
                old, n = sums.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                keys, inverse = np.unique(np.concatenate([old, grams[used]]), return_inverse=True)
                sums[lang] = keys, np.bincount(inverse, np.concatenate([n, weight[of][used]]), len(keys)).astype(np.int64)
            if sum(len(k) for k, _ in sums.values()) > FLUSH:
                yield from flushed()
    yield from flushed()


def hashed(gram: Column) -> Column:
    """Key of a packed n-gram; of 64-bit integers no two have the same."""
    return F.xxhash64(gram)


def trigrams(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)``: how often trigrams stand in ``(text, lang)``."""
    return written(
        docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("string").alias("text"))
        .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")


def frequent(tri: DataFrame, limit: int) -> DataFrame:
    """``(gram)`` that stand 2**k times or more, for the smallest k that at most ``limit`` reach."""
    counts = tri.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("k", F.floor(F.log2("n")))
    left, least = limit, 64
    for k, n in sorted(counts.groupBy("k").agg(F.count(F.lit(1))).collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = k
    return counts.where(F.col("k") >= least).select("gram")


def train(docs: DataFrame) -> DataFrame:
    """Model rows of ``(text, lang)``."""
    return modelled(trigrams(docs))


def modelled(tri: DataFrame) -> DataFrame:
    """Model rows ``(part, lang, h, value)`` from ``(lang, gram, n)``.

    Parts: ``p3, p2, p1`` interpolated probabilities of seen n-grams, ``g2, g1`` what a seen
    context leaves to the order below, ``p0`` one row per language for unseen letters.
    """
    mask = (1 << (2 * CHAR)) - 1
    low = tri.select("lang", F.col("gram").bitwiseAND(mask).alias("gram"), "n")
    bi = low.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    uni = bi.select("lang", F.col("gram").bitwiseAND((1 << CHAR) - 1).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    orders = []
    for counts in (tri, bi, uni):
        discount = counts.groupBy("lang").agg(
            F.try_divide(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 1) + 2 * F.count_if(F.col("n") == 2)).alias("d"))
        counts = counts.join(discount.select("lang", F.coalesce(F.nullif("d", F.lit(0.0)), F.lit(0.5)).alias("d")), "lang")
        context = Window.partitionBy("lang", "ctx")
        orders.append(
            counts.withColumn("ctx", F.shiftright("gram", CHAR))
            .withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.count(F.lit(1)).over(context))
            .select("lang", "gram", "ctx", (F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")).alias("own"),
                    (F.col("d") * F.col("kinds") / F.col("total")).alias("rest")))
    three, two, one = orders
    floor = one.groupBy("lang").agg((F.first("rest") / (F.count(F.lit(1)) + 1)).alias("p0"))
    p1 = one.join(floor, "lang").select("lang", "gram", (F.col("own") + F.col("p0")).alias("p1"))
    p2 = two.withColumn("low", F.col("gram").bitwiseAND((1 << CHAR) - 1)).join(p1.withColumnRenamed("gram", "low"), ["lang", "low"]) \
        .select("lang", "gram", (F.col("own") + F.col("rest") * F.col("p1")).alias("p2"))
    p3 = three.withColumn("low", F.col("gram").bitwiseAND(mask)).join(p2.withColumnRenamed("gram", "low"), ["lang", "low"]) \
        .select("lang", "gram", (F.col("own") + F.col("rest") * F.col("p2")).alias("p3"))
    part = lambda name, df, key, value: df.select(F.lit(name).alias("part"), "lang", hashed(F.col(key)).alias("h"), F.col(value).alias("value"))
    return part("p3", p3, "gram", "p3").unionByName(part("p2", p2, "gram", "p2")).unionByName(part("p1", p1, "gram", "p1")) \
        .unionByName(part("g2", three.dropDuplicates(["lang", "ctx"]), "ctx", "rest")).unionByName(part("g1", two.dropDuplicates(["lang", "ctx"]), "ctx", "rest")) \
        .unionByName(floor.select(F.lit("p0").alias("part"), "lang", F.lit(0).cast("long").alias("h"), F.col("p0").alias("value")))

def sorted_arrays(model: DataFrame) -> tuple[list[str], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Languages, and per part a sorted array of hashes with a column of logarithms per language.

    The whole model on one machine: for tests, which hold ``resolved`` against it.
    """
    found = model.toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    parts = np.array(found.column("part").to_pylist(), object)
    lang = np.searchsorted(langs, found.column("lang").to_pylist()) if langs else np.zeros(0, int)
    hashes, values = found.column("h").to_numpy(), found.column("value").to_numpy()
    out = {}
    for name in ("p3", "p2", "p1", "g2", "g1", "p0"):
        mine = parts == name
        keys, at = np.unique(hashes[mine], return_inverse=True)
        columns = np.full((len(keys) + 1, len(langs)), np.nan, np.float32)
        columns[at, lang[mine]] = np.log(np.maximum(values[mine], 1e-12))
        out[name] = keys, columns
    return langs, out


def log_probabilities(grams: np.ndarray, hashes: dict[str, np.ndarray], parts: dict) -> np.ndarray:
    """Logarithm of the probability of every trigram in every language, from ``sorted_arrays``."""
    def look(name: str) -> np.ndarray:
        keys, columns = parts[name]
        at = np.minimum(np.searchsorted(keys, hashes[name]), max(0, len(keys) - 1))
        return np.where((keys[at] == hashes[name])[:, None], columns[at], np.nan) if len(keys) else np.full((len(grams), columns.shape[1]), np.nan, np.float32)

    one = np.where(np.isnan(p := look("p1")), parts["p0"][1][0], p)
    two = np.where(np.isnan(p := look("p2")), one + np.nan_to_num(look("g1")), p)
    return np.where(np.isnan(p := look("p3")), two + np.nan_to_num(look("g2")), p)


_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for 64-bit integers."""
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    p1, p2, p3, p4, p5 = _XX
    h = np.uint64(42) + p5 + np.uint64(8)
    h = h ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).view(np.int64)


class Model:
    """Languages, unseen letters, the sharded model by key, and the most frequent trigrams for tasks."""

    def __init__(self, training: DataFrame):
        tri = trigrams(training)
        rows = written(modelled(tri), "model")
        log = F.log(F.greatest("value", F.lit(1e-12)))
        self.unseen = dict(sorted(rows.where("part = 'p0'").select("lang", log).collect()))
        self.langs = list(self.unseen)
        self.by_key = written(rows.where("part != 'p0'").groupBy("part", "h").agg(F.map_from_entries(F.collect_list(F.struct("lang", log))).alias("logs")), "model-keys")
        if not self.langs:
            return
        found = self.resolved(frequent(tri, HOT)).toArrow().combine_chunks().sort_by("gram")
        logs = found.column("logs").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(self.langs))
        self.hot = training.sparkSession.sparkContext.broadcast((found.column("gram").to_numpy(), logs))

    def resolved(self, grams: DataFrame) -> DataFrame:
        """``(gram, logs)``: logarithms of the probability of trigrams ``(gram)``, per language."""
        low = F.col("gram").bitwiseAND((1 << (2 * CHAR)) - 1)
        keys = {"p3": F.col("gram"), "p2": low, "p1": F.col("gram").bitwiseAND((1 << CHAR) - 1), "g2": F.shiftright("gram", CHAR), "g1": F.shiftright(low, CHAR)}
        asked = grams.select("gram", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), hashed(c).alias("h")) for k, c in keys.items()])).alias("key"))
        found = asked.select("gram", "key.part", "key.h").join(self.by_key, ["part", "h"], "left").groupBy("gram").agg(
            *[F.first(F.when(F.col("part") == k, F.col("logs")), ignorenulls=True).alias(k) for k in keys])
        at = lambda part, lang: F.try_element_at(part, F.lit(lang))
        none = F.lit(0.0)
        one = {x: F.coalesce(at("p1", x), F.lit(p0)) for x, p0 in self.unseen.items()}
        two = {x: F.coalesce(at("p2", x), one[x] + F.coalesce(at("g1", x), none)) for x in self.langs}
        three = [F.coalesce(at("p3", x), two[x] + F.coalesce(at("g2", x), none)) for x in self.langs]
        return found.select("gram", F.array(*three).cast("array<float>").alias("logs"))


def left_out(row: np.ndarray, word: np.ndarray, times: np.ndarray, grams: np.ndarray, of: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """``(row, gram, n)``: how often each row has each of the ``grams``, which stand in the words ``of``."""
    first = np.searchsorted(of, np.arange(words + 1))
    sizes = np.diff(first)[word]
    entry = np.repeat(np.arange(len(row)), sizes)
    at = first[word][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, gram, n = row[entry], grams[at], times[entry]
    order = np.lexsort((gram, row))
    row, gram, n = row[order], gram[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])[: len(row)])
    return row[new], gram[new], np.add.reduceat(n, new) if len(new) else n


_COLD = pa.struct([("gram", pa.int64()), ("n", pa.int64())])


def entropies(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``letters long`` (what was scored) and ``entropies`` (array, per language) to ``docs``; drops the text."""
    hot = model.hot
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("kept"), docs["text"].cast("string").alias("text"))
    kind = kept.schema["kept"].dataType.simpleString()
    n = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", CHARS_BYTES):
                points, starts, ends, row, word, times = distinct_words([t or "" for t in piece.column("text").to_pylist()])
                grams, of = word_trigrams(points, starts, ends)
                unique, inverse = np.unique(grams.view(np.int64), return_inverse=True)
                keys, known = hot.value
                at = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
                hit = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
                logs = np.zeros((len(unique), n), np.float32)
                logs[hit] = known[at[hit]]
                cold = ~hit[inverse]
                cold_row, cold_gram, cold_n = left_out(row, word, times, grams[cold].view(np.int64), of[cold], len(starts))
                rows, size = len(piece), ends - starts + 1
                letters = np.bincount(row, times * size[word], rows).astype(np.int64)
                sums = np.zeros((rows, n))
                for i in range(n):
                    of_word = np.bincount(of, logs[inverse, i], len(starts))
                    sums[:, i] = np.bincount(row, times * of_word[word], rows)
                values = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), n).cast(pa.list_(pa.float64()))
                rest = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(cold_row, np.arange(rows + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(cold_gram, pa.int64()), pa.array(cold_n, pa.int64())], fields=list(_COLD)))
                yield pa.RecordBatch.from_arrays([piece.column("kept"), pa.array(letters), values, rest], names=["kept", "letters", "sums", "cold"])

    part = written(kept.mapInArrow(run, f"kept {kind}, letters long, sums array<double>, cold array<struct<gram:bigint,n:bigint>>"), "sums") \
        .withColumn("row", F.monotonically_increasing_id())
    cold = part.where(F.size("cold") > 0).select("row", F.explode("cold").alias("c")).select("row", "c.gram", "c.n")
    more = cold.join(model.resolved(cold.select("gram").distinct()), "gram").groupBy("row").agg(
        F.array(*[F.sum(F.col("n") * F.col("logs")[i].cast("double")) for i in range(n)]).alias("more"))
    none = F.array(*[F.lit(0.0)] * n)
    mean = F.zip_with("sums", F.coalesce("more", none), lambda x, y: -(x + y) / F.greatest("letters", F.lit(1)))
    return part.drop("cold").join(more, "row", "left").select("kept.*", "letters", mean.alias("entropies"))


def identify(docs: DataFrame, training: DataFrame, quantile: float = 0.999) -> DataFrame:
    """Predict every row of ``docs``: adds ``lang_pred, score, entropy, rejected`` and drops the text.

    ``training`` has ``text`` and ``lang``; rows without a language are left out.
    """
    others = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "entropy", "rejected", "letters", "entropies")]
    docs = docs.select(*others)
    model = Model(training)
    langs = model.langs
    none = F.lit(None).cast("double")
    if not langs:
        return docs.drop("text").select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("entropy"), F.lit(False).alias("rejected"))
    names = F.array(*map(F.lit, langs))
    best = F.array_min("entropies")
    share = 1 / F.aggregate("entropies", F.lit(0.0), lambda s, x: s + F.exp(-SHARPNESS * (x - best)))
    spoken = F.col("letters") > 0
    kept_in = written(entropies(training.where("lang IS NOT NULL").select("text", F.col("lang").alias("own")), model).where(spoken)
                      .select("own", F.element_at("entropies", F.array_position(names, F.col("own")).cast("int")).alias("entropy")), "entropies")
    limits = kept_in.groupBy("own").agg(F.percentile_approx("entropy", quantile, 10_000).alias("limit")).toArrow()
    limit = F.create_map(*[F.lit(x) for pair in zip(limits.column("own").to_pylist(), limits.column("limit").to_pylist()) for x in pair])
    scored = entropies(docs, model).withColumn("lang_pred", F.when(spoken, F.element_at(names, F.array_position("entropies", best).cast("int"))).otherwise("und"))
    return scored.select(
        *[c for c in others if c != "text"], "lang_pred",
        F.when(spoken, share).otherwise(0.0).alias("score"),
        F.when(spoken, best).alias("entropy"),
        F.coalesce(F.try_element_at(limit, F.col("lang_pred")) < best, F.lit(False)).alias("rejected"),
    )


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@query("op4_langid")
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document; a quarter by crc32 of the id is held out from training."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(F.col("doc_id")) == 2, F.lit(False))
    training = docs.where(_remainder(F.col("doc_id")) != 2).select("text", "lang")
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), training)
