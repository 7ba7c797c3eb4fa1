from obscat.functions.links import announce_urls, build_link, rebuilt_link
from obscat.sources.releases import release_items, releases

HASH = "0123456789abcdef0123456789abcdef01234567"


def rows(spark):
    found = spark.createDataFrame([('[{"id":1,"name":{"main":"One"}}]',)], "body string")
    magnet = f"magnet:?xt=urn:btih:{HASH.upper()}&tr=udp%3A%2F%2Fb.x%3A80&TR=http%3A%2F%2Fa.x&tr=http%3A%2F%2Fc.x%3Fpasskey%3Dq"
    items = [f'[{{"id":1,"hash":"{HASH}","magnet":"{magnet}"}}, {{"id":2,"hash":"bad","magnet":"{magnet}"}}, {{"id":3,"hash":"{"1" * 40}","magnet":"{magnet}"}}]', '[{"id":4,"hash":"bad"}, {"id":0}]']
    return release_items(releases(found), spark.createDataFrame([(1, b) for b in items], "release_id int, body string"), "https://x")


def test_items_by_stated_and_named_hash(spark):
    got = {r.source_key: r for r in rows(spark).collect()}
    assert sorted(got) == ["1:1", "1:2"]
    assert {r.link for r in got.values()} == {f"magnet:?xt=urn:btih:{HASH}&tr=http%3A%2F%2Fa.x&tr=udp%3A%2F%2Fb.x%3A80"}
    assert (got["1:1"].warnings, got["1:2"].warnings) == ([], ["explicit_hash_invalid"])


def test_hashes_are_read_once_per_item(spark):
    plan = str(rows(spark)._jdf.queryExecution().optimizedPlan())
    assert plan.count("urn:btih:([0-9A-Fa-f]{40})") == 1


def test_a_link_is_read_once_for_its_announce_urls(spark):
    links = spark.createDataFrame([(HASH, f"magnet:?xt=urn:btih:{HASH}&tr=udp%3A%2F%2Fb.x"), (HASH, "no link"), (HASH, None)], "h string, l string")
    made = links.select(rebuilt_link("h", "l").alias("link"), build_link("h", announce_urls("l")).alias("other"))
    assert [r.link for r in made.collect()] == [r.other for r in made.collect()] == [f"magnet:?xt=urn:btih:{HASH}{t}" for t in ("&tr=udp%3A%2F%2Fb.x", "", "")]
    for c in made.columns:
        assert str(made.select(c)._jdf.queryExecution().optimizedPlan()).count("[?&]tr=") == 1
