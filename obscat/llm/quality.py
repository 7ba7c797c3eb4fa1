"""Quality classifier: perplexity under a character model of trusted text.

The model is an interpolated modified Kneser-Ney model of ``ORDER`` characters, counted over the
whole text of all trusted documents. Tasks count n-grams of their texts, Spark adds them up in
shards by n-gram, and joins of the counts with those of their contexts and of the next lower order
give discounts, continuation probabilities and what a context leaves to the order below. The
finished probabilities are keyed by the whole packed n-gram. Tasks hold those of the most frequent
n-grams of trusted text, at most ``HOT``; all other n-grams of a document leave the task with their
counts, and a join with the sharded model adds their share. ``HOT`` bounds what a task holds and
changes no result.

A document's perplexity is compared with a high quantile of the perplexities of trusted documents
of its language that the model was not trained on. Short texts are drawn towards the language's mean by ``PRIOR_CHARS`` characters,
and a text is only rejected where what it has above the limit adds up to ``EVIDENCE``: a few odd characters say nothing.

Cases: a null or empty text has no perplexity and is rejected; texts count whole; repeated rows are
counted and scored as often as they stand there; a null language is a language of its own, and one
without trusted documents takes the limit of all trusted documents; without any trusted text nothing is
rejected but empty texts. Result columns replace others of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obscat.llm.arrays import pieces
from obscat.llm.bitmaps import bitmap, may_hold
from obscat.llm.caches import only
from obscat.llm.registry import query, table
from obscat.llm.store import written

ORDER = 4
#: Bits of a character in a packed n-gram.
CHAR = 16
#: Most n-grams that tasks hold.
HOT = 1 << 21
QUANTILE = 0.999
PRIOR_CHARS = 300.0
#: Nats above the limit, over all characters of a text, below which nothing is rejected.
EVIDENCE = 30.0
#: One in so many trusted documents stays out of the model and sets the limits.
CALIBRATION = 5
FLUSH = 1_000_000
PIECE = 1 << 20
RESULT = ("n_scored", "perplexity", "limit", "kept")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(packed n-grams, bounds)``: one per character of every text, the first ones padded by line ends.

    Digits count as one character, so the model learns where numbers stand and not which.
    """
    pad = "\n" * (ORDER - 1)
    points = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.where((points >= 48) & (points < 58), np.uint64(48), (points ^ points >> np.uint64(CHAR)) & np.uint64((1 << CHAR) - 1))
    n = len(points) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    packed = np.zeros(n, np.uint64)
    for i in range(ORDER):
        packed = packed << np.uint64(CHAR) | points[i : i + n]
    starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
    keep = np.zeros(n + ORDER, np.int8)
    some = sizes > 0
    np.add.at(keep, starts[some], 1)
    np.add.at(keep, starts[some] + sizes[some], -1)
    return packed[np.cumsum(keep)[:n] > 0], np.concatenate([[0], np.cumsum(sizes)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(None)
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            found, times = np.unique(grams([t or "" for t in piece.column("text").to_pylist()])[0], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, times]), len(keys)).astype(np.int64)
            if len(keys) > FLUSH:
                yield pa.RecordBatch.from_pydict({"gram": keys.view(np.int64), "n": counts})
                keys, counts = keys[:0], counts[:0]
    yield pa.RecordBatch.from_pydict({"gram": keys.view(np.int64), "n": counts})


def counted(texts: DataFrame) -> DataFrame:
    """``(gram, n)``: how often n-grams stand in a table with ``text``."""
    return written(texts.where("text IS NOT NULL").select("text").mapInArrow(_count, "gram long, n long")
                   .groupBy("gram").agg(F.sum("n").alias("n")), "grams")


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """``(gram)`` that stand 2**k times or more, for the smallest k that at most ``limit`` reach."""
    counts = counts.withColumn("k", F.floor(F.log2("n")))
    left, least = limit, 64
    for k, n in sorted(counts.groupBy("k").agg(F.count(F.lit(1))).collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = k
    return counts.where(F.col("k") >= least).select("gram")


def trained(texts: DataFrame) -> DataFrame:
    """Model rows of a table with ``text``."""
    return modelled(counted(texts))


def modelled(counts: DataFrame) -> DataFrame:
    """Model rows ``(part, gram, value)`` from ``(gram, n)``.

    ``p1`` to ``p4`` are probabilities of seen n-grams, ``g1`` to ``g3`` what a seen context
    leaves to the order below, ``p0`` is the probability of a character never seen.
    """
    # lower orders count the different n-grams that end with them
    orders = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << (CHAR * order)) - 1
        orders[order] = orders[order + 1].select(F.col("gram").bitwiseAND(mask).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    parts, lower = [], None
    for order in range(1, ORDER + 1):
        own = orders[order]
        kinds = own.agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        discount = lambda i: F.greatest(F.coalesce(i - (i + 1) * y * F.nullif(F.col(f"n{i + 1}"), F.lit(0.0)) / F.nullif(F.col(f"n{i}"), F.lit(0.0)), F.lit(0.5)), F.lit(0.05))
        taken = kinds.select(*[discount(i).alias(f"d{i}") for i in (1, 2, 3)]).first()
        cut = F.when(F.col("n") == 1, taken[0]).when(F.col("n") == 2, taken[1]).otherwise(taken[2])
        context = F.shiftrightunsigned("gram", CHAR)
        here = Window.partitionBy("context")
        total = own.withColumn("context", context).withColumn("cut", F.least(cut, F.col("n"))).select(
            "gram", "context", "n", "cut", F.sum("n").over(here).alias("total"), F.sum("cut").over(here).alias("rest"))
        if lower is None:
            size = own.count()
            floor = F.col("rest") / F.col("total") / (size + 1)
            seen = total.select("gram", ((F.col("n") - F.col("cut")) / F.col("total") + floor).alias("value"))
            parts.append(total.select(F.lit("p0").alias("part"), F.lit(0).cast("long").alias("gram"), floor.alias("value")).limit(1))
        else:
            mask = (1 << (CHAR * (order - 1))) - 1
            seen = total.withColumn("low", F.col("gram").bitwiseAND(mask)).join(lower.select(F.col("gram").alias("low"), F.col("value").alias("below")).hint("merge"), "low").select(
                "gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("rest") / F.col("total") * F.col("below")).alias("value"))
            parts.append(total.groupBy("context").agg(F.max(F.col("rest") / F.col("total")).alias("value")).select(F.lit(f"g{order - 1}").alias("part"), F.col("context").alias("gram"), "value"))
        lower = written(seen, "probabilities")
        parts.append(lower.select(F.lit(f"p{order}").alias("part"), "gram", "value"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def sorted_arrays(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per part the sorted n-grams and the logarithms of their values.

    The whole model on one machine: for tests, which hold ``resolved`` against it.
    """
    found = model.orderBy("part", "gram").toArrow()
    parts, at = np.unique(np.array(found.column("part").to_pylist(), str), return_index=True)
    ends = [*at[1:], found.num_rows]
    gram, value = found.column("gram").to_numpy(), found.column("value").to_numpy()
    return {str(p): (gram[a:b], np.log(np.maximum(value[a:b], 1e-12)).astype(np.float32)) for p, a, b in zip(parts, at, ends)}


def log_probabilities(packed: np.ndarray, parts: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logarithm of the probability of the last character of every n-gram after those before it, from ``sorted_arrays``."""
    out = np.zeros(len(packed), np.float32)
    left = np.arange(len(packed))
    for order in range(ORDER, 0, -1):
        if not len(left):
            return out
        low = packed[left] & np.uint64((1 << (CHAR * order)) - 1) if order < 4 else packed[left]
        value, hit = _look(parts[f"p{order}"], low)
        out[left[hit]] += value[hit]
        left, low = left[~hit], low[~hit]
        if order > 1:
            value, hit = _look(parts[f"g{order - 1}"], low >> np.uint64(CHAR))
            out[left[hit]] += value[hit]
    out[left] += parts["p0"][1][0]
    return out


def _look(part: tuple[np.ndarray, np.ndarray], packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = part
    packed = packed.view(np.int64)
    at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
    return values[at], keys[at] == packed


class Model:
    """The sharded model of a table with ``text``, and its most frequent n-grams for tasks; ``unseen`` is None without text."""

    def __init__(self, texts: DataFrame):
        counts = counted(texts)
        self.rows = written(modelled(counts).withColumn("value", F.log(F.greatest("value", F.lit(1e-12)))), "model")
        unseen = self.rows.where("part = 'p0'").first()
        self.unseen = unseen and unseen["value"]
        if unseen:
            found = self.resolved(frequent(counts, HOT)).toArrow().combine_chunks().sort_by("gram")
            self.hot = texts.sparkSession.sparkContext.broadcast((found.column("gram").to_numpy(), found.column("log").to_numpy()))

    def resolved(self, grams: DataFrame) -> DataFrame:
        """``(gram, log)``: logarithm of the probability of the last character of n-grams ``(gram)`` after those before it."""
        low = lambda order: F.col("gram").bitwiseAND((1 << (CHAR * order)) - 1) if order < ORDER else F.col("gram")
        keys = {f"p{i}": low(i) for i in range(1, ORDER + 1)} | {f"g{i}": F.shiftrightunsigned(low(i + 1), CHAR) for i in range(1, ORDER)}
        # keys of one character are few, and common to many n-grams
        short = ("p1", "g1")
        asked = grams.select("gram", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), c.alias("key")) for k, c in keys.items() if k not in short])).alias("k"))
        own = self.rows.where(~F.col("part").isin("p0", *short)).select("part", F.col("gram").alias("key"), "value")
        found = asked.select("gram", "k.part", "k.key").join(own.hint("merge"), ["part", "key"], "left").groupBy("gram").agg(
            *[F.max(F.when(F.col("part") == k, F.col("value"))).alias(k) for k in keys if k not in short])
        for k in short:
            values = self.rows.where(F.col("part") == k).select(F.col("gram").alias("key"), F.col("value").alias(k))
            found = found.withColumn("key", keys[k]).join(F.broadcast(values), "key", "left").drop("key")
        log = F.coalesce("p1", F.lit(self.unseen))
        for i in range(2, ORDER + 1):
            log = F.coalesce(F.col(f"p{i}"), log + F.coalesce(f"g{i - 1}", F.lit(0.0)))
        return found.select("gram", log.cast("float").alias("log"))


_COLD = pa.struct([("gram", pa.int64()), ("n", pa.int64())])


def entropies(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """Add ``n_scored`` and ``entropy``, the mean negative logarithm per character; drops the text."""
    hot = model.hot
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text]).alias("kept"), docs[text].cast("string").alias("text"))
    kind = rows.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                packed, bounds = grams([t or "" for t in piece.column("text").to_pylist()])
                unique, at = np.unique(packed.view(np.int64), return_inverse=True)
                keys, known = hot.value
                place = np.minimum(np.searchsorted(keys, unique), max(0, len(keys) - 1))
                hit = keys[place] == unique if len(keys) else np.zeros(len(unique), bool)
                own = np.zeros(len(unique))
                own[hit] = known[place[hit]]
                logs = np.concatenate([[0.0], np.cumsum(own[at])])
                # what tasks do not hold: distinct n-grams of every row, with their counts
                left = np.flatnonzero(~hit[at])
                row = np.searchsorted(bounds, left, side="right") - 1
                pair, times = np.unique(row * np.int64(max(1, len(unique))) + at[left], return_counts=True)
                row, gram = pair // max(1, len(unique)), unique[pair % max(1, len(unique))]
                rest = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(len(piece) + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(gram, pa.int64()), pa.array(times, pa.int64())], fields=list(_COLD)))
                yield pa.RecordBatch.from_arrays([piece.column("kept"), pa.array(np.diff(bounds)), pa.array(np.diff(logs[bounds])), rest], names=["kept", "n_scored", "sum", "cold"])

    part = written(rows.mapInArrow(run, f"kept {kind}, n_scored long, sum double, cold array<struct<gram:bigint,n:bigint>>"), "sums") \
        .withColumn("row", F.monotonically_increasing_id())
    # Spark sizes what an explode gives by the arrays' table, far too low for a broadcast
    cold = part.where(F.size("cold") > 0).select("row", F.explode("cold").alias("c")).select("row", "c.gram", "c.n")
    more = cold.join(model.resolved(cold.select("gram").distinct()).hint("merge"), "gram").groupBy("row").agg(F.sum(F.col("n") * F.col("log").cast("double")).alias("more"))
    mean = -(F.col("sum") + F.coalesce("more", F.lit(0.0))) / F.greatest("n_scored", F.lit(1))
    return part.drop("cold").join(more.hint("merge"), "row", "left").select("kept.*", "n_scored", mean.alias("entropy"))


def _possible(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(None)
        for batch in batches:
            keep = may_hold(bits.value, batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.select(["id", "text"]).filter(pa.array(keep))

    return run


def trusted_texts(docs: DataFrame, trusted: DataFrame, id_column: str, text: str) -> DataFrame:
    """``(id, text)`` of the documents whose id is in ``trusted`` (``id``).

    A bitmap of fixed size leaves most other texts out before the shuffle; the join decides. It is never a
    broadcast one: what counts the texts would then share its stage with the bitmap, and every task need two Python workers.
    """
    spark = docs.sparkSession
    trusted = trusted.where("id IS NOT NULL").distinct()
    bits = spark.sparkContext.broadcast(bitmap(trusted.select(F.xxhash64("id").alias("h")), "h"))
    rows = docs.where(docs[id_column].isNotNull()).select(docs[id_column].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(_possible(bits), "id long, text string").join(trusted.hint("merge"), "id", "left_semi")


def score_quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``n_scored, perplexity, limit, kept`` to ``docs`` and drop the text.

    ``trusted`` names the documents of good quality in a column ``id``.
    """
    others = [c for c in docs.columns if c.lower() not in RESULT and c != text]
    trusted = trusted.select(F.col("id").cast("long").alias("id"))
    aside = F.pmod(F.xxhash64("id"), F.lit(CALIBRATION)) == 0
    model = Model(trusted_texts(docs, trusted.where(~aside), id_column, text))
    scores = docs.select(*others, text)
    if model.unseen is None:
        size = F.coalesce(F.char_length(F.col(text).cast("string")), F.lit(0))
        none = F.lit(None).cast("double")
        return scores.select(*others, size.cast("long").alias("n_scored"), none.alias("perplexity"), none.alias("limit"), (size > 0).alias("kept"))
    inner = scores.select(F.struct(*others).alias("kept_row"), F.col(id_column).cast("long").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    scored = written(entropies(inner, model, "text"), "entropies")
    sample = scored.join(trusted.where(aside).distinct().hint("merge"), "id", "left_semi").where("n_scored > 0")
    mean = F.lit(sample.agg(F.sum(F.col("entropy") * F.col("n_scored")) / F.sum("n_scored")).first()[0]).cast("double")
    drawn = (F.col("entropy") * F.col("n_scored") + mean * PRIOR_CHARS) / (F.col("n_scored") + PRIOR_CHARS)
    limits = sample.groupBy("lang").agg(F.percentile_approx(drawn, quantile, 10_000).alias("own_limit"))
    overall = sample.agg(F.percentile_approx(drawn, quantile, 10_000)).first()[0]
    limit = F.coalesce("own_limit", F.lit(overall).cast("double"), F.lit(float("inf")))
    return scored.join(limits, scored["lang"].eqNullSafe(limits["lang"]), "left").select(
        "kept_row.*", "n_scored", F.when(F.col("n_scored") > 0, F.exp(F.coalesce(drawn, "entropy"))).alias("perplexity"), F.exp(limit).alias("limit"),
        ((F.col("n_scored") > 0) & ((F.coalesce(drawn, "entropy") <= limit) | ((F.col("entropy") - limit) * F.col("n_scored") <= EVIDENCE))).alias("kept"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that the labels call good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("id"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is kept."""
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), trusted_ids(table(spark, sf_dir, "labels"))) \
        .select("doc_id", "n_scored", "perplexity", "limit", "kept")
