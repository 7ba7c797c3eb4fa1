"""Election of canonical rows."""

import datetime as dt

from obscat.operators.fold import fold, sparse
from obscat.operators.golden import golden_record, size_conflicts
from tests.test_fold import T0, frame, observation

H = "a" * 40


def items(spark, rows, as_of="2024-01-02 00:00:00", minutes=10_080):
    snapshot = fold(sparse(frame(spark, rows)))
    return {r["entity_hash"]: r for r in golden_record(snapshot, as_of, minutes).collect()}


def test_two_sources_make_one_item(spark):
    rows = [
        observation(1, key="1", source="src_b", at=10, entity_hash=H, bits=["title", "popularity", "types", "size"],
                    title="B", popularity=5, types=["Movie", " "], size_bytes=100, link="magnet:?xt=urn:btih:" + H),
        observation(2, key="2", source="src_a", at=20, entity_hash=H, bits=["popularity", "types", "quality"],
                    popularity=9, types=["movie", "anime"], quality=1080, details_state="partial",
                    link="magnet:?xt=urn:btih:" + H + "&tr=udp%3A%2F%2Fx.example"),
    ]
    item = items(spark, rows)[H]
    assert (item["source"], item["title"], item["popularity"]) == ("src_b", "B", 9)
    assert (item["quality"], item["size_bytes"]) == (1080, 100)
    assert item["types"] == ["anime", "Movie"]
    assert item["link"] == f"magnet:?xt=urn:btih:{H}&tr=udp%3A%2F%2Fx.example"


def test_stale_popularity_uses_only_the_newest_row(spark):
    rows = [
        observation(1, key="1", at=0, entity_hash=H, bits=["popularity"], popularity=90),
        observation(2, key="2", at=9, entity_hash=H, bits=["popularity"], popularity=3),
    ]
    late = (T0 + dt.timedelta(days=30)).isoformat(sep=" ")
    assert items(spark, rows, late, 60)[H]["popularity"] == 3
    assert items(spark, rows, late, 10**6)[H]["popularity"] == 90


def test_newest_row_without_popularity_gives_zero(spark):
    rows = [
        observation(1, key="1", at=0, entity_hash=H, bits=["popularity"], popularity=90),
        observation(2, key="2", at=9, entity_hash=H),
    ]
    assert items(spark, rows, "2025-01-01 00:00:00", 60)[H]["popularity"] == 0


def test_unobserved_everywhere_falls_back_to_defaults(spark):
    item = items(spark, [observation(1, entity_hash=H)])[H]
    assert (item["title"], item["size_bytes"], item["types"], item["seasons"]) == ("", 0, [], [])
    assert item["publish_date"] == T0


def test_size_conflict_needs_more_than_one_percent(spark):
    def conflict(a, b):
        rows = [
            observation(1, key="1", entity_hash=H, bits=["size"], size_bytes=a),
            observation(2, key="2", entity_hash=H, bits=["size"], size_bytes=b),
        ]
        return size_conflicts(fold(sparse(frame(spark, rows)))).count()

    assert (conflict(1000, 990), conflict(1000, 989)) == (0, 1)
