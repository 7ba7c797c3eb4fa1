"""Searches whose cost must not be queries times items."""

from obscat.operators import search as se


def test_hits_of_a_common_token_are_cut_before_the_queries(spark):
    items = spark.range(400).selectExpr("cast(id as string) AS entity_hash", "cast(id % 7 as int) AS popularity", "concat('Common ', id) AS title")
    # a row that comes twice is one hit
    items = items.unionByName(items.where("popularity = 6"))
    queries = spark.range(50).selectExpr("id AS query_id", "concat('COMMON  x ', id + 10) AS query")
    tokens = spark.createDataFrame([("common",), ("17",), ("zz",)], "token string")
    per_token = {r.token: r.n for r in se.token_hits(items, tokens, limit=5).groupBy("token").count().withColumnRenamed("count", "n").collect()}
    assert per_token == {"common": 5, "17": 5}

    rows = {r.entity_hash: (-r.popularity, r.entity_hash, r.title.lower()) for r in items.collect()}
    want = set()
    for query in range(50):
        found = sorted(v for v in rows.values() if "common" in v[2] or str(query + 10) in v[2])
        want |= {(query, v[1], i + 1) for i, v in enumerate(found[:5])}
    assert {tuple(r) for r in se.many_titles(items, queries, limit=5).collect()} == want
    few, se.FEW_TOKENS = se.FEW_TOKENS, 1
    try:
        assert {tuple(r) for r in se.many_titles(items, queries, limit=5).collect()} == want
    finally:
        se.FEW_TOKENS = few


def test_links_of_a_media_id_need_only_the_rows_of_its_keys(spark, monkeypatch):
    from obscat.operators import fold as fo
    from tests.test_fold import frame, random_log

    rows = random_log(41, 120)
    for i, row in enumerate(rows):
        row["media_id"] = 12 if i % 9 == 0 and row["source_key"] in ("k1", "k3") else i % 5
    log = fo.sparse(frame(spark, rows))
    linked = lambda obs: sorted(map(str, fo.media_links(fo.accepted(obs)).where("media_id = 12").collect()))
    few = fo.keys_of_media(log, 12)
    keys = {(r["source"], r["source_key"]) for r in rows if r["media_id"] == 12}
    assert few.count() == sum((r["source"], r["source_key"]) in keys for r in rows) < len(rows)
    assert linked(few) == linked(log) != []
    monkeypatch.setattr(fo, "FEW_KEYS", 0)
    assert fo.keys_of_media(log, 12).count() == len(rows)
