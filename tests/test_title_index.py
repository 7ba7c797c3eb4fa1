"""The title index gives what reading all names gives, from blocks of a bounded size."""

import random

import pytest
from pyspark.sql import functions as F

from obscat.operators import title_index as ti
from obscat.operators.search import many_titles

WORDS = ["alpha", "alps", "beta", "gamma", "xx", "zeta 77", "Ärger", "al"]


def tables(spark, seed, n=120):
    rng = random.Random(seed)
    items = [(f"i{i:03d}", rng.randrange(12) if i % 9 else None, " ".join(rng.choices(WORDS, k=3)), None if i % 3 else rng.choice(WORDS)) for i in range(n)]
    items.append(("none", 5, None, None))
    queries = [(1, "al"), (2, "ZETA"), (3, "77 xx"), (4, "nothing"), (5, "q"), (6, "ärger beta"), (7, ""), (8, "gamma alpha al")]
    return (
        spark.createDataFrame(items, "entity_hash string, popularity int, title string, name string"),
        spark.createDataFrame(queries, "query_id int, query string"),
    )


@pytest.mark.parametrize("block,limit", [(1, 3), (7, 10), (1000, 500)])
def test_index_equals_a_scan(spark, tmp_path, block, limit):
    items, queries = tables(spark, block)
    index = ti.build(items, str(tmp_path / "index"), block=block)
    found = sorted(tuple(r) for r in ti.search(index, queries, str(tmp_path / "rounds"), limit).collect())
    plain = many_titles(items.withColumn("popularity", F.coalesce("popularity", F.lit(-1))), queries, limit=limit)
    assert found == sorted(tuple(r) for r in plain.collect())


def test_a_common_piece_is_many_bounded_blocks(spark, tmp_path, many_slices):
    items, _ = tables(spark, 3, 300)
    index = ti.build(items, str(tmp_path / "index"), block=10)
    assert ti.postings_per_task(index) <= 10
    common = index.blocks.groupBy("gram").agg(F.count("*").alias("n"), F.max("best").alias("best")).orderBy(F.desc("n")).first()
    assert common.n > 10
    tops = [r.best for r in index.blocks.where(F.col("gram") == common.gram).orderBy("block").collect()]
    assert tops == sorted(tops, reverse=True)


def test_search_stops_at_the_most_popular_hits(spark, tmp_path):
    items = spark.range(2000).select(F.format_string("i%05d", "id").alias("entity_hash"), (2000 - F.col("id")).alias("popularity"), F.lit("same name").alias("title"))
    index = ti.build(items, str(tmp_path / "index"), block=10)
    queries = spark.createDataFrame([(1, "same")], "query_id int, query string")
    found = ti.search(index, queries, str(tmp_path / "rounds"), 15).orderBy("rank").collect()
    assert [r.item for r in found] == [f"i{i:05d}" for i in range(15)]
    assert not (tmp_path / "rounds" / "open-3").exists()


def test_no_items_and_no_queries(spark, tmp_path):
    items, queries = tables(spark, 1)
    index = ti.build(items.limit(0), str(tmp_path / "index"))
    assert ti.search(index, queries, str(tmp_path / "a")).count() == 0
    index = ti.build(items, str(tmp_path / "index2"))
    assert ti.search(index, queries.limit(0), str(tmp_path / "b")).count() == 0


def test_many_queries_read_a_token_once(spark, tmp_path):
    items, _ = tables(spark, 5, 60)
    queries = spark.range(40).select(F.col("id").cast("int").alias("query_id"), F.lit("gamma al").alias("query"))
    found = ti.search(ti.build(items, str(tmp_path / "index"), block=10), queries, str(tmp_path / "rounds"), 4)
    assert found.groupBy("query_id").count().where("count = 4").count() == 40
    # hits of two tokens, not of forty queries
    assert spark.read.parquet(str(tmp_path / "rounds" / "hits-1")).count() <= 8
