"""Page scan and source adapters."""

import pytest
from pyspark.sql import functions as F

from obscat.operators import facts as fa
from obscat.sources import registry
from obscat.sources.pages import page_rows, scan_pages

PAGE = """
<html><head><style>b{}</style><script>var t="<b>No:</b> x";</script></head><body>
<table><tr><td>Год&nbsp;выпуска:</td><td>2024</td><td>z</td></tr><tr><td>alone</td></tr>
<tr><th>Size<td>5 GB</table>
<b>Quality:</b> BDRip <i>1080p</i><br><strong>Empty:</strong><br>
<b>not a label</b> text <dl><dt>Audio</dt><dd>Русский</dd></dl>
<div class="sp-wrap big"><div class="sp-head">MediaInfo</div><div class="sp-body"><b>In:</b> x<br>Format : MKV<br/><br>End</div></div>
<p>broken <b>Tail: value</p>
"""


def test_facts_of_a_broken_page():
    found = [(k, label, value) for k, _, label, value in page_rows(PAGE)]
    assert ("fact", "Год выпуска:", "2024") in found
    assert ("fact", "Size", "5 GB") in found
    assert ("fact", "Quality:", "BDRip 1080p") in found
    assert ("fact", "Audio", "Русский") in found
    assert ("section", "MediaInfo", "In: x\nFormat : MKV\nEnd") in found
    assert not any(label.startswith(("No", "not a", "In")) for _, label, _ in found)
    assert [r for r in page_rows("")] == []


def test_scan_and_merge(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<b>A:</b> x<br><b>a:</b> y<br><b>A:</b> x"), (3, None)], "page_id long, html string")
    rows = scan_pages(pages).withColumn("tie_key", F.lit(""))
    merged = {(r.page_id, r.label): r.value for r in fa.merge_facts(rows.where("kind = 'fact'")).collect()}
    assert merged[(1, "Quality")] == "BDRip 1080p"
    assert merged[(2, "A")] == "x | y"


def test_suffix_and_redaction(spark):
    facts = spark.createDataFrame(
        [(1, 1, "Audio:", "a"), (1, 2, "audio", "b"), (1, 3, "Session token", "s"), (1, 4, "Скорость", "9"), (1, 5, "x" * 81, "v")],
        "page_id long, seq int, label string, value string",
    ).withColumn("tie_key", F.lit(""))
    keys = {r.seq: r.key for r in fa.suffix_facts(facts).collect()}
    assert keys == {1: "Audio", 2: "audio 2", 3: "Session token", 4: "Скорость"}
    kept, warnings = fa.redact_facts(facts)
    assert {r.seq for r in kept.collect()} == {1, 2, 5}
    assert [r.page_id for r in warnings.collect()] == [1]


def test_sections_drop_telemetry(spark):
    rows = spark.createDataFrame([("MediaInfo", "x"), ("Transfer rate", "y"), ("User list", "z"), ("", "")], "label string, value string")
    assert [r.label for r in fa.visible_sections(rows).collect()] == ["MediaInfo"]


def test_source_registry(spark):
    @registry.source("demo")
    def demo(raw):
        return raw.select(F.col("id").cast("string").alias("source_key"), F.lit("t").alias("title"))

    @registry.source("bad")
    def bad(raw):
        return raw.withColumn("surprise", F.lit(1))

    row = registry.read_source("demo", spark.range(1)).first()
    assert (row["source"], row["source_key"], row["title"], row["voices"]) == ("demo", "0", "t", None)
    with pytest.raises(ValueError):
        registry.read_source("bad", spark.range(1))


def test_one_break_right_after_a_label_is_crossed():
    rows = list(page_rows("<div><b>About:</b><br>text <i>more</i><br>rest <b>Gap:</b><br><br>far <b>End:</b> x<br>y</div>"))
    assert [(label, value) for _, _, label, value in rows] == [("About:", "text more"), ("Gap:", ""), ("End:", "x")]


def test_a_page_is_freed_without_the_collector():
    import gc

    from obscat.sources.pages import Node

    gc.collect()
    gc.disable()
    try:
        assert len(list(page_rows(PAGE))) > 4
        next(page_rows(PAGE))
        assert not [o for o in gc.get_objects() if isinstance(o, Node)]
    finally:
        gc.enable()


def test_parts_are_not_collected_for_a_join(spark):
    from obscat.plans import QUERIES

    found = QUERIES["link_build"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in found and "SortMergeJoin" in found
