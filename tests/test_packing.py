from itertools import product

from pyspark.sql import functions as F

from obscat.operators import packing

KIND = "source string, source_key string, entity_hash string, link string, source_url string, title string, n int, a array<string>, b array<string>, arrival_key string"
ROWS = [
    ("s", "k", "00ff" * 10, "magnet:" + "00ff" * 10, "http://x/k", "t", 1, ["a", "b"], [], "ab" * 16),
    ("s", None, None, None, None, None, None, None, None, None),
    ("s", "", "", "magnet:", "", "", 2, [""], ["", ""], ""),
    ("s", "1", "ABCD", "ABCD-ABCD", "http://1/11", "\x1e", 3, [None], [None, "x", None], "abc"),
    ("s", "\x1a", "zz", "z\x1azz", "\x1c", "\x1c\x1c", 4, ["\x1d", None, ""], ["\x1b"], "0g"),
    ("s", "k", "00", "é ", "k\x1fk", "\x1b", 5, ["\x1c"], [None, None], "ПР"),
]


def test_rows_come_back_as_they_were(spark):
    rows = spark.createDataFrame(ROWS, KIND)
    for keys, pack in product((["source", "source_key"], ["entity_hash"], ["n"]), (packing.ROWS, packing.HASHES)):
        out = packing.shuffled(rows, keys, pack)
        assert out.dtypes == rows.dtypes
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_bytes_that_are_no_text_come_back(spark):
    rows = spark.createDataFrame([(1, "a", ["b"], bytes([255, 65]))], "n int, t string, l array<string>, raw binary") \
        .select("n", "l", F.col("raw").cast("string").alias("t"), F.array(F.col("raw").cast("string"), F.lit("é")).alias("m"))
    out = packing.shuffled(rows, ["n"]).select(F.hex(F.col("t").cast("binary")), F.hex(F.col("m")[0].cast("binary")), F.col("m")[1], "l").first()
    assert tuple(out) == ("FF41", "FF41", "é", ["b"])


def test_packed_rows_have_few_columns(spark):
    node = packing.shuffled(spark.createDataFrame(ROWS, KIND), ["source", "source_key"])._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "RepartitionByExpression":
        node = node.children().head()
    names = [node.output().apply(i).name() for i in range(node.output().size())]
    assert sorted(names) == ["_odd", "_texts", "arrival_key", "entity_hash", "n", "source", "source_key"]
