"""Column functions on chosen values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from obscat.functions import dates, links, text
from obscat.operators import facts as fa
from obscat.operators.search import apply_filters, clamp_limit, search_tokens

HASH = "0123456789abcdef0123456789abcdef01234567"


def value(spark, make, *args):
    kinds = ", ".join(f"a{i} string" for i in range(len(args)))
    df = spark.createDataFrame([tuple(args)], kinds)
    return df.select(make(*[F.col(f"a{i}") for i in range(len(args))]).alias("v")).first()["v"]


@pytest.mark.parametrize("make, raw, want", [
    (text.normalize_text, " a   b\t\n", "a b"),
    (text.clear_query, "Тест: x_1 (é)", "Тест x 1"),
    (text.search_key, "Ёж Щука-2!", "ежшука2"),
    (text.search_key, "!!", None),
    (text.size_bytes, "14.29 GB", 15343770665),
    (text.size_bytes, "1,5 гб", 1610612736),
    (text.size_bytes, "none", None),
    (text.exact_bytes, "14.29 GB (15347435004 Bytes)", 15347435004),
    (text.quality, "WEB 1080P", 1080),
    (text.quality, " 720 ", 720),
    (text.quality, "HD", 0),
    (text.frame_height, "1920х1080", 1080),
    (text.year, "x 12019 1999-2001", 1999),
    (text.year, "18990 1899", 0),
    (text.media_format, "a\nFormat : Matroska \r\nx", "Matroska"),
    (text.author, "posted by: Some One ", "Some One"),
    (text.url_key, "https://x.example/v.php?a=1&t=77", "77"),
    (text.url_key, "https://x.example/torrent/5/name", "/torrent/5"),
    (text.id_kind, "tt123", "imdb"), (text.id_kind, "kp5", "kp"), (text.id_kind, " 9 ", "tmdb"),
    (text.id_kind, "tt12x", "text"),
    (text.cyrillic_query, "Имя Name", "Имя"), (text.cyrillic_query, "Имя", None),
])
def test_text(spark, make, raw, want):
    assert value(spark, make, raw) == want


@pytest.mark.parametrize("size, want", [
    (0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1152, "1.13 KB"), (7654321, "7.3 MB"),
    (15347435004, "14.29 GB"), (2**50, "1024 TB"),
])
def test_size_label(spark, size, want):
    assert spark.range(1).select(text.size_label(F.lit(size)).alias("v")).first()["v"] == want


@pytest.mark.parametrize("title, kinds, want", [
    ("Show S01-03 x", ["s_range"], [1, 2, 3]), ("S3-1", ["s_range"], []), ("S01-40", ["s_range"], []),
    ("S00", ["s_range"], []), ("x [1-2 Сезон] S05", ["bracket", "s_range"], [1, 2, 5]),
    ("сезон 2", ["word"], [2]), ("Имя [ТВ-2]", ["anime"], [2]), ("none", ["s_range", "anime"], []),
])
def test_seasons(spark, title, kinds, want):
    assert value(spark, lambda c: text.seasons(c, kinds), title) == want


@pytest.mark.parametrize("title, want", [
    ("Фильм / Alt / Film (Some One) [2001, x", ("Фильм", "Film", 2001)),
    ("Фильм в 3Д / Film in 3D (A) [2001, x", ("Фильм", "Film", 2001)),
    ("Фильм (A) [2001, x", ("Фильм", None, 2001)),
    ("Фильм 2005", ("Фильм 2005", None, 2005)),
])
def test_movie_titles(spark, title, want):
    assert tuple(value(spark, text.movie_title, title)) == want


@pytest.mark.parametrize("title, want", [
    ("Шоу / A / B / Show / Сезон: 1 / Серии: 1-2 (X) [2001, y", ("Шоу", "Show", 2001)),
    ("Шоу / Show / Сезон: 1 / Серии: 1-2 (X) [2001-2002, y", ("Шоу", "Show", 2001)),
    ("Шоу / сезон: 1 / Серии: 1-2 (X) [2001, y", ("Шоу", None, 2001)),
    ("Шоу / Show / rest (X) [2001, y", ("Шоу", "Show", 2001)),
    ("Шоу 1999", ("Шоу 1999", None, 1999)),
])
def test_serial_titles(spark, title, want):
    assert tuple(value(spark, text.serial_title, title)) == want


@pytest.mark.parametrize("make, raw, want", [
    (links.link_hash, "magnet:?xt=urn:btih:" + HASH.upper(), HASH),
    (links.link_hash, "MAGNET:?dn=x&XT=URN:BTIH:" + HASH + "&tr=y", HASH),
    (links.link_hash, "magnet:?xt=urn%3Abtih%3A" + HASH, HASH),
    (links.link_hash, "magnet:?xt=urn:sha1:x&xt=urn:btih:" + HASH, HASH),
    (links.link_hash, "magnet:?xt=urn:btih:zz&xt=urn:btih:" + HASH, None),
    (links.link_hash, "magnet:?xt=urn:btmh:1220" + "ab" * 32, "ab" * 32),
    (links.link_hash, "http://x.example/?xt=urn:btih:" + HASH, None),
    (links.normalize_hash, "AERUKZ4JVPG66AJDIVTYTK6N54ASGRLH", HASH),
    (links.normalize_hash, "AERUKZ4JVPG66AJDIVTYTK6N54ASGRL1", None),
    (links.display_name, "magnet:?xt=1&dn=A+B%20C", "A+B C"),
    (links.sanitize_link, "magnet:?xt=1&passkey=2&tr=http%3A%2F%2Fx%2F%3Fauthorization%3D1&a=b", "magnet:?xt=1&a=b"),
    (links.sanitize_link, "https://x.example/?token=1", "https://x.example/?token=1"),
])
def test_links(spark, make, raw, want):
    assert value(spark, make, raw) == want


def test_long_base32_hash(spark):
    import base64

    raw = bytes(range(7, 39))
    encoded = base64.b32encode(raw).decode().rstrip("=")
    assert len(encoded) == 52
    assert value(spark, links.normalize_hash, encoded.lower()) == raw.hex()


@pytest.mark.parametrize("link, explicit, want", [
    ("", None, "missing_magnet"), ("magnet:?xt=x", None, "invalid_magnet"),
    ("magnet:?xt=urn:btih:" + HASH, "zz", "invalid_hash"),
    ("magnet:?xt=urn:btih:" + HASH, "f" * 40, "hash_mismatch"),
    ("magnet:?xt=urn:btih:" + HASH, HASH.upper(), None), ("magnet:?xt=urn:btih:" + HASH, " ", None),
])
def test_identity(spark, link, explicit, want):
    assert value(spark, links.identity_error, link, explicit) == want


@pytest.mark.parametrize("raw, safe, stripped", [
    ("/a?b=1#c", "https://h.example/a?b=1", "https://h.example/a?b=1"),
    ("x.png", "https://h.example/d/x.png", "https://h.example/d/x.png"),
    ("//c.example", "https://c.example/", "https://c.example/"),
    ("/a?x=1&amp;token=2", None, "https://h.example/a?x=1"),
    ("https://u:p@h.example/", None, None), ("javascript:x", None, None), (" ", None, None),
    ("http://h.example:80/ф", "http://h.example/%D1%84", "http://h.example/%D1%84"),
])
def test_urls(spark, raw, safe, stripped):
    base = "https://h.example/d/page?q=1"
    assert value(spark, links.safe_url, raw, base) == safe
    assert value(spark, links.stripped_url, raw, base) == stripped


@pytest.mark.parametrize("make, raw, want", [
    (dates.short_date, "10 Май 24", dt.datetime(2024, 5, 10)),
    (dates.short_date, "31 Фев 24", None),
    (dates.long_date, "10 мая 2024 в 12:30", dt.datetime(2024, 5, 10, 12, 30)),
    (lambda c: dates.long_date(c, 3), "1 мая 2024 в 1:30", dt.datetime(2024, 4, 30, 22, 30)),
    (dates.long_date, "10 никогда 2024", None),
    (dates.topic_date, "22-Сен-26 03:19", dt.datetime(2026, 9, 22, 3, 19)),
    (dates.topic_date, "10.05.24 10:35", dt.datetime(2024, 5, 10, 10, 35)),
    (dates.topic_date, "5 Jan 2020", dt.datetime(2020, 1, 5)),
    (dates.dashed_date, "01-02-2024 3:04:05 (ago)", dt.datetime(2024, 2, 1, 3, 4, 5)),
    (dates.dotted_date, "01.02.2024 в 03:04", dt.datetime(2024, 2, 1, 3, 4)),
    (dates.unix_date, "1000000000", dt.datetime(2001, 9, 9, 1, 46, 40)),
    (dates.unix_date, "946684800", None),
    (dates.iso_date, "2024-05-01T10:00:00+03:00", dt.datetime(2024, 5, 1, 7)),
    (dates.iso_date, "soon", None),
])
def test_dates(spark, make, raw, want):
    assert value(spark, make, raw) == want


def test_legacy_text(spark):
    assert value(spark, lambda c: text.legacy_text(text.legacy_bytes(c)), "Привет, Ёж №1") == "Привет, Ёж №1"
    raw = "Привет".encode("cp1251")
    df = spark.createDataFrame([(raw,)], "b binary")
    assert df.select(text.legacy_text("b").alias("v")).first()["v"] == "Привет"


def test_tokens_and_limits(spark):
    assert value(spark, search_tokens, "Ab aB x %y_ zz") == ["Ab", "zz"]
    assert value(spark, search_tokens, "a b") is None
    assert [clamp_limit(n) for n in (-1, 0, 7, 9999)] == [1, 1, 7, 2000]


def test_filters_skip_year_for_serials(spark):
    df = spark.createDataFrame([(2000, ["movie"]), (2001, ["movie"])], "release_year int, types array<string>")
    assert apply_filters(df, year=2000).count() == 1
    assert apply_filters(df, year=2000, is_serial=2).count() == 2
    assert apply_filters(df, type=" ").count() == 2


def test_named_languages(spark):
    assert value(spark, fa.named_languages, "Русский (DUB), английский; Klingon") == ["Русский", "английский"]


def test_telemetry_parts(spark):
    assert value(spark, fa.without_telemetry, "a | Upload speed 5 | b") == "a b"
