"""Title search through an index that is written once.

Postings are the items of every two- and three-letter piece of their names. Those of a piece are numbered by
popularity and cut into blocks of ``BLOCK`` items, so a piece that most names hold is many rows of a bounded size and
no task gets it whole. A search looks every distinct token up by its rarest piece and goes through the blocks from the
most popular on, twice as many in every round; a token is done when its last wanted hit is more popular than anything in
the blocks not seen yet, so a common piece is read to its end only where too few names match. The best hits of a query are
among the best of its tokens, so queries meet the hits of their tokens last, and many queries with one token read it once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obscat.functions.text import search_tokens
from obscat.operators.search import DEFAULT_LIMIT, NAME_COLUMNS, _grams, clamp_limit
from obscat.operators.skew import numbered

BLOCK = 1_000
#: Names of an item in a posting are joined by a character that no token holds.
BETWEEN = "\n"


class TitleIndex:
    """Written postings and block sizes of an index folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings = spark.read.parquet(f"{path}/postings")
        self.blocks = spark.read.parquet(f"{path}/blocks")


def build(items: DataFrame, path: str, item: str = "entity_hash", block: int = BLOCK) -> TitleIndex:
    """Write the index of ``items`` (``item``, ``popularity`` and names)."""
    spark = items.sparkSession
    names = [c for c in NAME_COLUMNS if c in items.columns]
    lowered = [F.coalesce(F.lower(c), F.lit("")) for c in names]
    grams = F.array_distinct(F.concat(*[_grams(c, size) for c in lowered for size in (2, 3)]))
    rows = items.select(
        F.col(item).alias("item"), F.coalesce(F.col("popularity").cast("long"), F.lit(-(1 << 62))).alias("popularity"),
        F.concat_ws(BETWEEN, *lowered).alias("names"), F.explode(grams).alias("gram"))
    falling = F.bitwise_not("popularity")
    ranked = numbered(rows, ["gram"], [F.desc("popularity"), F.asc("item")], "_n", falling)
    cut = ranked.withColumn("block", F.floor((F.col("_n") - 1) / block).cast("long")).drop("_n")
    # numbered rows of a piece, or of a slice of it, lie together already
    cut.sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/postings")
    sizes = spark.read.parquet(f"{path}/postings").groupBy("gram", "block").agg(F.max("popularity").alias("best"), F.count(F.lit(1)).alias("n"))
    sizes.write.mode("overwrite").parquet(f"{path}/blocks")
    return TitleIndex(spark, path)


def _lookups(index: TitleIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, token, gram)``: tokens of the queries with their rarest piece; tokens that no name can hold are left out."""
    asked = queries.select("query_id", F.explode(F.transform(search_tokens("query"), lambda t: F.lower(t))).alias("token")).distinct()
    tokens = asked.select("token").distinct()
    piece = F.when(F.length("token") >= 3, _grams(F.col("token"), 3)).otherwise(_grams(F.col("token"), 2))
    pieces = tokens.select("token", F.explode(piece).alias("gram"))
    frequency = index.blocks.groupBy("gram").agg(F.sum("n").alias("n"))
    rarest = pieces.join(frequency, "gram", "left").groupBy("token").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r"))
    return asked.join(rarest.where("r.n IS NOT NULL").select("token", "r.gram"), "token")


def search(index: TitleIndex, queries: DataFrame, path: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``(query_id, item, rank)``: the most popular hits of every query ``(query_id, query)``; rounds are written below ``path``."""
    spark, limit = index.spark, clamp_limit(limit)

    def keep(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    asked = keep(_lookups(index, queries), "lookups")
    open_ = keep(asked.select("token", "gram").distinct(), "open-0")
    best = Window.partitionBy("token").orderBy(F.desc("popularity"), "item")
    held = keep(open_.select("token", F.lit(None).cast(index.postings.schema["item"].dataType).alias("item"), F.lit(0).cast("long").alias("popularity")).limit(0), "hits-0")
    done: list[DataFrame] = []
    low, high, number = 0, 1, 0
    while not open_.isEmpty():
        number += 1
        seen = index.postings.where((F.col("block") >= low) & (F.col("block") < high))
        found = seen.join(open_, "gram").where(F.contains("names", "token")).select("token", "item", "popularity")
        hits = held.unionByName(found).distinct().withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit)
        held = keep(hits.drop("_n"), f"hits-{number}")
        left = index.blocks.where(F.col("block") == high).select("gram", F.col("best").alias("ahead"))
        last = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("popularity").alias("last"))
        ahead = open_.join(left, "gram").join(last, "token", "left")
        more = ahead.where((F.coalesce("n", F.lit(0)) < limit) | (F.col("ahead") >= F.col("last")))
        still = keep(more.select("token", "gram"), f"open-{number}")
        tokens = still.select("token")
        done.append(held.join(tokens, "token", "left_anti"))
        open_, held, low, high = still, held.join(tokens, "token", "left_semi"), high, 2 * high
    out = held.limit(0)
    for part in done:
        out = out.unionByName(part)
    per_query = Window.partitionBy("query_id").orderBy(F.desc("popularity"), "item")
    out = asked.join(out, "token").select("query_id", "item", "popularity").distinct()
    ranked = out.select("query_id", "item", F.row_number().over(per_query).cast("long").alias("rank"))
    return ranked.where(F.col("rank") <= limit)


def postings_per_task(index: TitleIndex) -> int:
    """Most rows of one piece that a task can get at once: the largest block."""
    return index.blocks.agg(F.max("n")).first()[0] or 0


__all__: Sequence[str] = ("BLOCK", "TitleIndex", "build", "postings_per_task", "search")
