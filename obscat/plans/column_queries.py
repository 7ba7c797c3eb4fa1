"""Queries over text, links, dates, pages and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from obscat.functions import dates, fixed, links, text
from obscat.operators import facts as fa
from obscat.operators import fold as fo
from obscat.operators import validate as va
from obscat.plans.fold_queries import obs, sql
from obscat.plans.registry import query
from obscat.sources.pages import scan_pages
from obscat.sources.releases import release_items, releases
from obscat.sources.views import csv_array, oracle, table, view

HEX = "lower(substr(link, 21, 40))"


def titles(spark, sf_dir):
    return view(spark, sf_dir, "v_titles")


# --- text -----------------------------------------------------------------------------------

@query("x_text", """SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normal,
  md5(trim(regexp_replace(regexp_replace(text, '[^a-zA-Zа-яА-ЯёЁ0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS cleared,
  md5(regexp_replace(translate(lower(text), 'ёщ', 'еш'), '[^a-z0-9а-я]', '', 'g')) AS key FROM documents""")
def x_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(text.normalize_text("text")).alias("normal"),
        F.md5(text.clear_query("text")).alias("cleared"),
        F.md5(F.coalesce(text.search_key("text"), F.lit(""))).alias("key"),
    )


@query("x_size_label", """SELECT l_orderkey, l_linenumber, b, regexp_replace(regexp_replace(printf('%.2f', round(CASE WHEN b >= 1099511627776 THEN b / 1099511627776.0 WHEN b >= 1073741824 THEN b / 1073741824.0
  WHEN b >= 1048576 THEN b / 1048576.0 WHEN b >= 1024 THEN b / 1024.0 ELSE b END, 2)), '0+$', ''), '\\.$', '') ||
  CASE WHEN b >= 1099511627776 THEN ' TB' WHEN b >= 1073741824 THEN ' GB' WHEN b >= 1048576 THEN ' MB' WHEN b >= 1024 THEN ' KB' ELSE ' B' END AS label
  FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) * CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 3000 WHEN 2 THEN 700000 ELSE 90000000 END AS b FROM lineitem)""")
def x_size_label(spark, sf_dir):
    scale = F.element_at(F.array(*[F.lit(x) for x in (1, 3000, 700000, 90000000)]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.round("l_extendedprice").cast("long") * scale).alias("b")
    )
    return rows.withColumn("label", text.size_label("b"))


@query("x_size_parse", oracle("""SELECT item_id, CAST(round_even(v * m, 0) AS BIGINT) AS bytes, CAST(floor(v * m) AS BIGINT) AS cut FROM (SELECT item_id,
  CAST(replace(regexp_extract(size_text, '[0-9]+([.,][0-9]+)?'), ',', '.') AS DOUBLE) AS v,
  CASE item_id % 3 WHEN 0 THEN 1073741824.0::DOUBLE WHEN 1 THEN 1048576.0::DOUBLE ELSE 1099511627776.0::DOUBLE END AS m FROM v_titles)""", "v_titles"))
def x_size_parse(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "item_id", text.size_bytes("size_text").alias("bytes"),
        text.size_bytes("size_text", rounded=False).alias("cut"),
    )


@query("x_quality", oracle("""SELECT item_id, CAST(coalesce(nullif(regexp_extract(title, '(\\d{3,4})p', 1), ''), '0') AS INT) AS quality,
  CAST(item_id AS INT) AS plain, CAST(item_id % 1000 + 100 AS INT) AS height FROM v_titles""", "v_titles"))
def x_quality(spark, sf_dir):
    frame = F.concat(F.lit("video 1920 X "), F.col("item_id") % 1000 + 100)
    return titles(spark, sf_dir).select(
        "item_id", text.quality("title").alias("quality"),
        text.quality(F.concat(F.lit(" "), "item_id", F.lit(" "))).alias("plain"),
        text.frame_height(frame).alias("height"),
    )


@query("x_year", """SELECT doc_id, CAST(coalesce(list_filter(regexp_extract_all(concat(text, ' 12019 1899 ', CAST(1890 + doc_id % 250 AS VARCHAR)), '[0-9]+'), lambda x: length(x) = 4 AND x[1:2] IN ('19', '20'))[1], '0') AS INT) AS year FROM documents""")
def x_year(spark, sf_dir):
    body = F.concat(F.col("text"), F.lit(" 12019 1899 "), (F.lit(1890) + F.col("doc_id") % 250).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.year(body).alias("year"))


_SEASONS_SQL = """SELECT item_id, array_to_string(list_sort(list_distinct(flatten([
    CASE WHEN CAST(substr(s, 6, 2) AS INT) >= CAST(substr(s, 3, 2) AS INT) THEN range(CAST(substr(s, 3, 2) AS INT), CAST(substr(s, 6, 2) AS INT) + 1) ELSE [] END,
    CASE WHEN item_id % 40 + item_id % 35 < 100 AND item_id % 40 > 0 AND item_id % 35 <= 30 THEN range(item_id % 40, item_id % 40 + item_id % 35 + 1) ELSE [] END]))), ',') AS seasons
  FROM (SELECT item_id, regexp_extract(title, ' S[0-9]{2}-[0-9]{2}') AS s FROM v_titles)"""


@query("x_seasons", oracle(_SEASONS_SQL, "v_titles"))
def x_seasons(spark, sf_dir):
    low = F.col("item_id") % 40
    title = F.concat("title", F.lit(" ["), low, F.lit("-"), low + F.col("item_id") % 35, F.lit(" Сезон]"))
    found = text.seasons(title, ["bracket", "s_range"])
    return titles(spark, sf_dir).select(
        "item_id", F.array_join(F.transform(found, lambda s: s.cast("string")), ",").alias("seasons")
    )


@query("x_array_ci", oracle("SELECT arrival_key, upper(details_state) || ',' || source || ',' || title AS names FROM v_obs", "v_obs"))
def x_array_ci(spark, sf_dir):
    names = F.array(F.upper("details_state"), "details_state", "source", F.upper("source"), "title", F.lower("title"))
    return view(spark, sf_dir, "v_obs").select(
        "arrival_key", F.array_join(text.distinct_ci(names), ",").alias("names")
    )


@query("x_tokens", """SELECT conv_id, turn, array_to_string(list_filter(l, lambda w, i: list_position(list_transform(l, lambda x: lower(x)), lower(w)) = i), ' ') AS tokens
  FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ' '),
    lambda w: regexp_replace(trim(regexp_replace(w, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[%_]', '', 'g')), lambda w: length(w) >= 2) AS l FROM conversations)""")
def x_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    tokens = text.search_tokens(F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "turn", F.array_join(tokens, " ").alias("tokens"))


@query("x_cyrillic_query", oracle("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'слово' END AS fallback FROM v_titles""", "v_titles"))
def x_cyrillic_query(spark, sf_dir):
    mixed = F.concat(F.when(F.col("item_id") % 2 == 0, "word ").otherwise(""), F.lit("слово"))
    return titles(spark, sf_dir).select("item_id", text.cyrillic_query(mixed).alias("fallback"))


@query("x_types", oracle("""SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'movie' WHEN item_id % 4 = 1 THEN 'multserial' WHEN item_id % 2 = 0 THEN 'multserial' ELSE 'multfilm' END AS type FROM v_titles""", "v_titles"))
def x_types(spark, sf_dir):
    i = F.col("item_id")
    title = F.concat(F.lit("Name "), F.when(i % 4 == 1, "3 серии").when(i % 4 == 3, "сериал").otherwise("S02"))
    seasons = text.seasons(title)
    kind = F.when(i % 5 == 0, "movie").otherwise("multfilm")
    episodic = F.when(i % 5 != 0, "multserial")
    types = text.content_types(title, seasons, kind, episodic)
    return titles(spark, sf_dir).select("item_id", F.array_join(types, ",").alias("type"))


_FLAVOURS = ("slash", "cyrillic", "cut", "movie", "serial", "generic")
_FLAVOUR_SQL = """ft AS (SELECT p_partkey AS item_id, CASE p_partkey % 6 WHEN 0 THEN 'slash' WHEN 1 THEN 'cyrillic' WHEN 2 THEN 'cut' WHEN 3 THEN 'movie' WHEN 4 THEN 'serial' ELSE 'generic' END AS flavour,
  CASE p_partkey % 6
    WHEN 0 THEN concat(p_name, ' / ', p_brand, ' / Third (', CAST(1970 + p_size AS VARCHAR(4)), ') BDRip')
    WHEN 1 THEN concat(p_name, '  /  Имя ', p_brand, ' (', CAST(1970 + p_size AS VARCHAR(4)), ') WEBRip 720p')
    WHEN 2 THEN concat('Имя [x] | ', p_name, ' (y) / z ', CAST(1970 + p_size AS VARCHAR(4)), ' HDTVRip')
    WHEN 3 THEN concat('Фильм в 3Д / ', p_name, ' in 3D (Автор) [', CAST(1970 + p_size AS VARCHAR(4)), ', x] BDRemux')
    WHEN 4 THEN concat('Шоу / ', p_name, ' / Сезон: 1 / Серии: 1-8 (Автор) [', CAST(1970 + p_size AS VARCHAR(4)), '-', CAST(1971 + p_size AS VARCHAR(4)), '] WEB-DL')
    ELSE concat(p_name, CASE WHEN p_partkey % 12 = 5 THEN ' Сезон 2' ELSE '' END, ' [', CAST(1970 + p_size AS VARCHAR(4)), ', ] DVDRip') END AS title FROM {part})"""


@query("title_attributes", "WITH " + _FLAVOUR_SQL.format(part="part") + """ SELECT item_id, title, flavour,
  CASE flavour WHEN 'slash' THEN p_name WHEN 'cyrillic' THEN concat('Имя ', p_brand) WHEN 'cut' THEN 'Имя' WHEN 'movie' THEN 'Фильм' WHEN 'serial' THEN 'Шоу' ELSE p_name END AS name,
  CASE flavour WHEN 'slash' THEN 'Third' WHEN 'generic' THEN NULL ELSE p_name END AS original_name, CAST(1970 + p_size AS INT) AS release_year,
  CASE flavour WHEN 'slash' THEN 'BDRip' WHEN 'cyrillic' THEN 'WEBRip' WHEN 'cut' THEN 'HDTVRip' WHEN 'movie' THEN 'BDRemux' WHEN 'serial' THEN 'WEB-DL' ELSE 'DVDRip' END AS video_type,
  CAST(CASE flavour WHEN 'cyrillic' THEN 720 ELSE 0 END AS INT) AS quality
  FROM ft JOIN part ON item_id = p_partkey WHERE p_partkey % 12 <> 5""")
def title_attributes(spark, sf_dir):
    rows = spark.sql("WITH " + _FLAVOUR_SQL + " SELECT * FROM ft", part=table(spark, sf_dir, "part"))
    return text.title_table(rows)


_KINDS_SQL = """kinds AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'slash' WHEN 1 THEN 'cut' WHEN 2 THEN 'movie' ELSE 'cyrillic' END AS flavour,
  concat(title, CASE floor(item_id / 4) % 3 WHEN 0 THEN '' ELSE ' end' END) AS title FROM (SELECT p_partkey AS item_id, concat(p_name, ' [',
    CASE p_size % 7 WHEN 0 THEN 'HDTVRip' WHEN 1 THEN 'Blu-Ray Remux' WHEN 2 THEN 'WEB-DL-HEVC' WHEN 3 THEN 'bdrip-AVC' WHEN 4 THEN 'UHD  BDRemux' WHEN 5 THEN 'HDRip-AVC' ELSE 'XWEBRip' END,
    '] ', p_brand) AS title FROM {part}))"""


def _family_sql(family):
    pattern = fixed.VIDEO_TYPE_PATTERNS[family].replace("'", "''")
    return f"nullif(regexp_extract(title, '{pattern}', 0), '')"


@query("title_video_types", "WITH " + _KINDS_SQL.format(part="part") + f""" SELECT item_id, flavour, CASE flavour WHEN 'slash' THEN {_family_sql("short")}
  WHEN 'cut' THEN {_family_sql("broadcast")} WHEN 'movie' THEN {_family_sql("remux")} ELSE {_family_sql("full")} END AS video_type FROM kinds""")
def title_video_types(spark, sf_dir):
    rows = spark.sql("WITH " + _KINDS_SQL + " SELECT * FROM kinds", part=table(spark, sf_dir, "part"))
    return rows.select("item_id", "flavour", text.video_type_of("title", "flavour").alias("video_type"))


@query("title_parsed_info", oracle("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN '1080p' WHEN 1 THEN '720p' WHEN 2 THEN '2160p' END AS resolution,
  CASE item_id % 4 WHEN 0 THEN 'BDRip' WHEN 1 THEN 'WEB-DLRip' WHEN 2 THEN 'UHD BDRemux' ELSE 'HDRip' END AS quality, CASE WHEN item_id % 2 = 0 THEN 'x265' END AS codec,
  'dts' AS audio, CAST(1 + item_id % 3 AS INT) AS season FROM v_titles""", "v_titles"))
def title_parsed_info(spark, sf_dir):
    tail = F.when(F.col("item_id") % 2 == 0, " x265 DTS").otherwise(" DTS")
    rows = titles(spark, sf_dir).select("item_id", text.parsed_info(F.concat("title", tail)).alias("i"))
    return rows.select("item_id", *[f"i.{c}" for c in ("resolution", "quality", "codec", "audio", "season")])


@query("x_mediainfo", oracle("""SELECT item_id, 'MP4 ' || item_id AS format, CASE WHEN length(explicit_hash) = 40 OR (length(explicit_hash) = 32 AND regexp_matches(explicit_hash, '^[a-z2-7]+$')) THEN explicit_hash END AS hash, size_text AS piece FROM v_titles""", "v_titles"))
def x_mediainfo(spark, sf_dir):
    block = F.concat(F.lit("General\r\nformat : MP4 "), "item_id", F.lit("  \r\nFormat : other"))
    page = F.concat(F.lit("x Инфо-хеш: [ "), "explicit_hash", F.lit(" ]"))
    piece = F.concat(F.lit("размер части  торрента: "), "size_text")
    return titles(spark, sf_dir).select(
        "item_id", text.media_format(block).alias("format"), text.page_hash(page).alias("hash"),
        text.piece_size(piece).alias("piece"),
    )


@query("x_charset", oracle("SELECT item_id, date_text FROM v_titles", "v_titles"))
def x_charset(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "item_id", text.legacy_text(text.legacy_bytes("date_text")).alias("date_text")
    )


@query("x_page_text", oracle("""SELECT item_id, 'Кино>HD ' || item_id AS crumbs, 'Ann ' || item_id AS author, 'file ' || item_id || '.torrent' AS file, CAST(item_id AS INT) AS counter FROM v_titles""", "v_titles"))
def x_page_text(spark, sf_dir):
    i = F.col("item_id").cast("string")
    crumbs = text.breadcrumbs(F.concat(F.lit(" Кино »  » HD "), i, F.lit(" ")))
    return titles(spark, sf_dir).select(
        "item_id", F.array_join(crumbs, ">").alias("crumbs"),
        text.author(F.concat(F.lit("Added By: Ann "), i, F.lit("  "))).alias("author"),
        text.strip_prefix(F.concat(F.lit("скачать file "), i, F.lit(".torrent"))).alias("file"),
        text.first_int(F.concat(F.lit("seen "), i, F.lit(" times 9"))).alias("counter"),
    )


# --- dates ------------------------------------------------------------------------------------

@query("x_dates", oracle("""SELECT item_id, CASE WHEN item_id % 3 = 2 THEN NULL ELSE d END AS long_date, CASE WHEN item_id % 3 = 2 THEN NULL ELSE d + INTERVAL 9 HOUR + INTERVAL 30 MINUTE END AS msk_date,
  make_timestamp(2000 + item_id % 30, 5, 1 + item_id % 28, 0, 0, 0) AS short_date, make_timestamp(2000 + item_id % 30, 9, 1 + item_id % 28, 3, 19, 0) AS topic_date,
  make_timestamp(2000 + item_id % 25, 3, 10 + item_id % 15, 7, 8, 9) AS dashed, make_timestamp(2000 + item_id % 25, 3, 10 + item_id % 15, 17, 8, 0) AS dotted,
  CASE WHEN item_id % 9 <> 0 THEN make_timestamp(2001, 9, 9, 1, 46, 40) + item_id * INTERVAL 1 SECOND END AS unix,
  make_timestamp(2024, 5, 1, 7, 0, CAST(item_id % 60 AS DOUBLE)) AS iso
  FROM (SELECT item_id, make_timestamp(CAST(right(date_text, 4) AS BIGINT), CASE item_id % 3 WHEN 0 THEN 5 ELSE 12 END, CAST(split_part(date_text, ' ', 1) AS BIGINT), 0, 0, 0) AS d FROM v_titles)""", "v_titles"))
def x_dates(spark, sf_dir):
    i = F.col("item_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day, late, year = two(1 + i % 28), two(10 + i % 15), (2000 + i % 25).cast("string")
    yy = two(i % 30)
    return titles(spark, sf_dir).select(
        "item_id", dates.long_date("date_text").alias("long_date"),
        dates.long_date(F.concat("date_text", F.lit(" в 12:30")), 3).alias("msk_date"),
        dates.short_date(F.concat(day, F.lit(" Май "), yy)).alias("short_date"),
        dates.topic_date(F.concat(day, F.lit("-Сен-"), yy, F.lit(" 03:19"))).alias("topic_date"),
        dates.dashed_date(F.concat(late, F.lit("-03-"), year, F.lit(" 7:08:09 (x)"))).alias("dashed"),
        dates.dotted_date(F.concat(late, F.lit(".03."), year, F.lit("  в 17:08"))).alias("dotted"),
        dates.unix_date(F.when(i % 9 == 0, F.lit("946684800")).otherwise((F.lit(1_000_000_000) + i).cast("string"))).alias("unix"),
        dates.iso_date(F.concat(F.lit("2024-05-01T10:00:"), two(i % 60), F.lit("+03:00"))).alias("iso"),
    )


# --- links ------------------------------------------------------------------------------------

@query("x_hash", """SELECT p_partkey AS item_id, h AS hex40, CASE WHEN p_partkey % 2 = 0 THEN concat(h, substr(h, 1, 24)) END AS hex64, lower(h) AS b32, NULL::VARCHAR AS bad
  FROM (SELECT p_partkey, concat(md5(CAST(p_partkey AS VARCHAR)), substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8)) AS h FROM part)""")
def x_hash(spark, sf_dir):
    h = F.concat(F.md5(F.col("p_partkey").cast("string")), F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8))
    rows = table(spark, sf_dir, "part").select("p_partkey", h.alias("h"))
    # base-32 of the same 20 bytes, five bytes (eight letters) at a time
    pieces = [F.lpad(F.conv(F.substring("h", 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    b32 = F.translate(F.concat(*pieces), fixed.BASE32_TO, fixed.BASE32_FROM)
    long = F.concat("h", F.substring("h", 1, 24))
    return rows.select(
        F.col("p_partkey").alias("item_id"),
        links.normalize_hash(F.concat(F.lit(" "), F.upper("h"))).alias("hex40"),
        links.normalize_hash(F.when(F.col("p_partkey") % 2 == 0, long).otherwise(F.substring(long, 1, 63))).alias("hex64"),
        links.normalize_hash(F.lower(b32)).alias("b32"),
        links.normalize_hash(F.concat(F.substring("h", 1, 31), F.lit("1"))).alias("bad"),
    )


@query("x_link_hash", oracle(f"SELECT item_id, {HEX} AS hash FROM v_titles", "v_titles"))
def x_link_hash(spark, sf_dir):
    return titles(spark, sf_dir).select("item_id", links.link_hash("link").alias("hash"))


@query("x_link_params", oracle("""SELECT item_id, CASE WHEN item_id % 11 = 0 THEN '' ELSE 'https://t' || item_id % 6 || '.example/announce' END AS announce,
  url_decode(regexp_extract(link, 'dn=([^&]*)', 1)) AS name FROM v_titles""", "v_titles"))
def x_link_params(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "item_id", F.array_join(links.announce_urls("link"), " ").alias("announce"),
        links.display_name("link").alias("name"),
    )


@query("x_link_sanitize", oracle("""SELECT item_id, CASE WHEN item_id % 11 = 0 THEN regexp_replace(link, '&tr=.*$', '') ELSE link END AS link FROM v_titles""", "v_titles"))
def x_link_sanitize(spark, sf_dir):
    dirty = F.when(F.col("item_id") % 2 == 0, F.concat("link", F.lit("&user_id=4&"))).otherwise(F.col("link"))
    return titles(spark, sf_dir).select("item_id", links.sanitize_link(dirty).alias("link"))


@query("identity_resolve", oracle(f"""SELECT item_id, CASE WHEN explicit_hash = 'zz' THEN 'invalid_hash'
  WHEN length(explicit_hash) = 32 AND NOT regexp_matches(upper(explicit_hash), '^[A-Z2-7]+$') THEN 'invalid_hash'
  WHEN explicit_hash <> {HEX} THEN 'hash_mismatch' END AS error_code FROM v_titles""", "v_titles"))
def identity_resolve(spark, sf_dir):
    return titles(spark, sf_dir).select(
        "item_id", links.identity_error("link", "explicit_hash").alias("error_code")
    )


@query("link_build", oracle("""SELECT p_type, 'magnet:?xt=urn:btih:' || md5(p_type) || substr(md5(p_type), 1, 8) || coalesce(string_agg(DISTINCT tr, '' ORDER BY tr), '') AS link FROM
  (SELECT p_type, CASE WHEN item_id % 11 = 0 THEN NULL ELSE '&tr=https%3A%2F%2Ft' || item_id % 6 || '.example%2Fannounce' END AS tr
   FROM v_titles JOIN part ON item_id = p_partkey) GROUP BY p_type""", "v_titles"))
def link_build(spark, sf_dir):
    # both sides have a row per part: neither is to be collected for a broadcast
    kinds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_type")
    rows = titles(spark, sf_dir).select("item_id", "link").join(kinds.hint("merge"), "item_id")
    each = rows.select("p_type", F.explode_outer(links.announce_urls("link")).alias("u"))
    urls = each.groupBy("p_type").agg(F.collect_set("u").alias("u"))
    h = F.concat(F.md5("p_type"), F.substring(F.md5("p_type"), 1, 8))
    return urls.select("p_type", links.build_link(h, "u").alias("link"))


_URL_ROWS = """urls AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'token=1') WHEN 2 THEN replace(url, '://', '://u:p@')
  WHEN 3 THEN '/path?a=1#x' WHEN 4 THEN 'ftp://h.example/x' WHEN 5 THEN '//cdn.example/z?passkey=1&amp;b=2' WHEN 6 THEN ' ' ELSE 'HTTPS://Host.Example:443' END AS raw, url FROM {pages})"""


@query("url_clean", "WITH " + _URL_ROWS.format(pages="pages") + """, b AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin, regexp_extract(url, '^[a-z]+') AS scheme FROM urls)
  SELECT page_id, CASE page_id % 8 WHEN 0 THEN bare WHEN 1 THEN CASE WHEN contains(url, '#') THEN bare END WHEN 3 THEN origin || '/path?a=1' WHEN 5 THEN scheme || '://cdn.example/z?passkey=1&b=2' WHEN 7 THEN 'https://host.example/' END AS safe,
  CASE page_id % 8 WHEN 0 THEN bare WHEN 1 THEN CASE WHEN contains(url, '#') THEN bare ELSE url END WHEN 3 THEN origin || '/path?a=1' WHEN 5 THEN scheme || '://cdn.example/z?b=2' WHEN 7 THEN 'https://host.example/' END AS stripped FROM b""")
def url_clean(spark, sf_dir):
    rows = spark.sql("WITH " + _URL_ROWS + " SELECT * FROM urls", pages=table(spark, sf_dir, "pages"))
    return rows.select(
        "page_id", links.safe_url("raw", "url").alias("safe"), links.stripped_url("raw", "url").alias("stripped")
    )


@query("url_key", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN CAST(page_id AS VARCHAR) ELSE '/torrent/' || page_id END AS key FROM pages""")
def url_key(spark, sf_dir):
    p = F.col("page_id")
    url = F.when(p % 4 == 0, F.col("url")).when(p % 4 == 1, F.concat(F.lit("https://a.example/v.php?f=2&t="), p)).when(
        p % 4 == 2, F.concat(F.lit("https://a.example/d.php?ID="), p, F.lit("&x=1"))).otherwise(F.concat(F.lit("https://a.example/torrent/"), p, F.lit("/name")))
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(url).alias("key"))


_PAYLOAD_SQL = """SELECT item_id, 'link=' || CASE WHEN item_id % 11 = 0 THEN regexp_replace(link, '&tr=.*$', '') ELSE link END || ';note=' || title || ';url=https://h.example/p' ||
  CASE WHEN item_id % 2 = 0 THEN '?a=1' ELSE '?b=2&c=3' END || ';user_name=NULL' AS payload FROM v_titles"""


@query("payload_sanitize", oracle(_PAYLOAD_SQL, "v_titles"))
def payload_sanitize(spark, sf_dir):
    url = F.when(F.col("item_id") % 2 == 0, "https://h.example/p?a=1&session_id=7&x.token=2").otherwise("https://h.example/p?b=2&c=3")
    fragment = F.create_map(
        F.lit("link"), F.col("link"), F.lit("note"), F.col("title"), F.lit("url"), url,
        F.lit("user_name"), F.lit("someone"),
    )
    pairs = F.transform(
        F.array_sort(F.map_entries(links.sanitize_map(fragment))),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL"))),
    )
    return titles(spark, sf_dir).select("item_id", F.array_join(pairs, ";").alias("payload"))


@query("payload_merge", oracle("SELECT item_id, 'a=' || item_id || ';b=' || CASE WHEN item_id % 2 = 0 THEN 'new' ELSE 'old' END || CASE WHEN item_id % 2 = 0 THEN ';c=3' ELSE '' END AS payload FROM v_titles", "v_titles"))
def payload_merge(spark, sf_dir):
    i = F.col("item_id")
    stored = F.create_map(F.lit("a"), i.cast("string"), F.lit("b"), F.lit("old"))
    incoming = F.when(i % 2 == 0, F.create_map(F.lit("b"), F.lit("new"), F.lit("c"), F.lit("3"))).otherwise(
        F.map_filter(F.create_map(F.lit("z"), F.lit("z")), lambda k, v: F.lit(False))
    )
    pairs = F.transform(
        F.array_sort(F.map_entries(fa.merge_maps(stored, incoming))),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return titles(spark, sf_dir).select("item_id", F.array_join(pairs, ";").alias("payload"))


# --- pages --------------------------------------------------------------------------------------

_MARKED_SQL = """marked AS (SELECT page_id, html FROM pages UNION ALL
  SELECT -1 - page_id, CASE page_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN concat(html, '<p>JUST a moment') WHEN 2 THEN concat(html, '<i id="cf-chl-x">') WHEN 3 THEN concat('{"message":"Unauthenticated."}', html)
    WHEN 4 THEN replace(html, '<article', '<section') ELSE concat(html, 'DDoS-Guard "unauthenticated."') END FROM pages)"""


@query("page_class", "WITH " + _MARKED_SQL + """ SELECT page_id, CASE WHEN trim(html) = '' THEN 'invalid_response'
  WHEN regexp_matches(lower(html), 'cf-chl-|cf_chl|just a moment|checking your browser|challenge-platform|ddos-guard') THEN 'challenge'
  WHEN contains(lower(html), '"unauthenticated."') OR contains(lower(html), 'name="login_username"') THEN 'authentication'
  WHEN NOT contains(html, '<article') THEN 'parser_contract' ELSE 'usable' END AS class FROM marked""")
def page_class(spark, sf_dir):
    rows = _marked(spark, sf_dir)
    surface = F.col("html").contains("<article")
    return rows.select("page_id", va.page_class(surface=surface).alias("class"))


def _marked(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    p, html = F.col("page_id"), F.col("html")
    changed = (
        F.when(p % 6 == 0, "  ").when(p % 6 == 1, F.concat(html, F.lit("<p>JUST a moment")))
        .when(p % 6 == 2, F.concat(html, F.lit('<i id="cf-chl-x">')))
        .when(p % 6 == 3, F.concat(F.lit('{"message":"Unauthenticated."}'), html))
        .when(p % 6 == 4, F.replace(html, F.lit("<article"), F.lit("<section")))
        .otherwise(F.concat(html, F.lit('DDoS-Guard "unauthenticated."')))
    )
    return pages.unionByName(pages.select((-1 - p).alias("page_id"), changed.alias("html")))


@query("page_links", """SELECT DISTINCT page_id, out AS url FROM (SELECT page_id, url, CASE WHEN regexp_matches(h, '^[a-z]+:') THEN h ELSE regexp_extract(url, '^[a-z]+://[^/?#]+') ||
    array_to_string(list_transform(string_split(h, ''), lambda c: CASE WHEN regexp_matches(c, '^[\\x21-\\x7e]$') THEN c ELSE url_encode(c) END), '') END AS out
  FROM (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1), ['/own', 'https://other.example/x' || page_id])) AS h FROM pages))
  WHERE regexp_matches(out, '^https?://') AND NOT starts_with(out, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/') """)
def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = F.concat(
        F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1)),
        F.array(F.lit("/own"), F.concat(F.lit("https://other.example/x"), "page_id")),
    )
    rows = pages.select("page_id", "url", F.explode(F.array_distinct(found)).alias("raw"))
    clean = rows.select("page_id", links.safe_url("raw", "url").alias("link"), links.url_host("url").alias("own"))
    foreign = F.col("link").isNotNull() & (links.url_host("link") != F.col("own"))
    return clean.where(foreign).select("page_id", F.col("link").alias("url")).distinct()


def _rich_pages(spark, sf_dir):
    p = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit("<div id='x'><table><tr><td>Год&nbsp;выпуска:</td><td>"), (F.lit(1990) + F.col("page_id") % 40).cast("string"),
        F.lit("</td></tr><tr><th>Only</th></tr></table><b>Качество:</b> BDRip <i>"), p,
        F.lit("</i><br><b>Session token:</b> s<br><b>Скорость:</b> 5<br><dl><dt>Аудио</dt><dd>Русский</dd></dl>"
              "<div class='sp-wrap'><div class='sp-head'>MediaInfo</div><div class='sp-body'><b>no:</b> x<br>Format : MP4 "), p,
        F.lit("<br>End</div></div><div class='spoiler'><div class='spoiler-title'>user list</div><div class='spoiler-content'>u</div></div></div>"),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("</b></p></article>"), extra).alias("html"))


@query("page_facts", """SELECT page_id, label, value FROM (SELECT page_id, unnest(['Год выпуска:', 'Качество:', 'Session token:', 'Скорость:', 'Аудио']) AS label,
  unnest([CAST(1990 + page_id % 40 AS VARCHAR), 'BDRip ' || page_id, 's', '5', 'Русский']) AS value FROM pages)""")
def page_facts(spark, sf_dir):
    facts = scan_pages(_rich_pages(spark, sf_dir)).where("kind = 'fact'")
    return facts.where(F.length("label") <= fixed.MAX_LABEL).select("page_id", "label", "value")


@query("page_sections", "SELECT page_id, 'MediaInfo' AS label, concat('no: x', chr(10), 'Format : MP4 ', CAST(page_id AS VARCHAR), chr(10), 'End') AS value, 'MP4 ' || page_id AS format FROM pages")
def page_sections(spark, sf_dir):
    sections = scan_pages(_rich_pages(spark, sf_dir)).where("kind = 'section'")
    kept = fa.visible_sections(sections)
    return kept.select("page_id", "label", "value", text.media_format("value").alias("format"))


# --- facts ----------------------------------------------------------------------------------------

def facts(spark, sf_dir):
    return view(spark, sf_dir, "v_facts")


@query("fact_merge", oracle("""SELECT page_id, arg_min(label, pos) AS label, list_reduce(list(value ORDER BY pos), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || ' | ' || b END) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq, tie_key) AS pos FROM v_facts) GROUP BY page_id, lower(label)""", "v_facts"))
def fact_merge(spark, sf_dir):
    return fa.merge_facts(facts(spark, sf_dir))


@query("fact_suffix", oracle("""SELECT page_id, seq, tie_key, CASE WHEN n > 1 THEN label || ' ' || n ELSE label END AS key FROM
  (SELECT *, row_number() OVER (PARTITION BY page_id, lower(label) ORDER BY seq, tie_key) AS n FROM v_facts)""", "v_facts"))
def fact_suffix(spark, sf_dir):
    return fa.suffix_facts(facts(spark, sf_dir)).select("page_id", "seq", "tie_key", "key")


@query("fact_lookup", oracle("""SELECT page_id, year, quality, CAST(coalesce(nullif(regexp_extract(year, '[0-9]+'), ''), NULL) AS INT) AS number FROM (SELECT page_id,
  arg_min(value, CASE lower(label) WHEN 'year' THEN 0 ELSE 1 END * 100000 + seq * 1000 + tk) FILTER (WHERE lower(label) IN ('year', 'audio')) AS year,
  arg_min(value, seq * 1000 + tk) FILTER (WHERE label = 'Quality') AS quality FROM (SELECT *, row_number() OVER (PARTITION BY page_id, seq ORDER BY tie_key) AS tk FROM v_facts) GROUP BY page_id)""", "v_facts"))
def fact_lookup(spark, sf_dir):
    found = fa.lookup_facts(
        facts(spark, sf_dir), {"year": ["Year", "AUDIO"], "quality": ["Resolution", "Quality"]}, order=fa.ORDER
    )
    return found.withColumn("number", text.first_int("year"))


@query("fact_split", oracle("""SELECT page_id, seq, tie_key, CASE WHEN label = 'Language' THEN 'Русский+English+рус' ELSE value END AS parts,
  CASE WHEN label = 'Language' THEN 'Русский, English+рус' ELSE value END AS bars FROM v_facts""", "v_facts"))
def fact_split(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "page_id", "seq", "tie_key", F.array_join(fa.split_values("value"), "+").alias("parts"),
        F.array_join(fa.split_values("value", ";|"), "+").alias("bars"),
    )


@query("fact_languages", oracle("SELECT page_id, CASE WHEN bool_or(label = 'Language') THEN 'Русский' ELSE '' END AS languages FROM v_facts WHERE label IN ('Language', 'Audio', 'audio') GROUP BY page_id", "v_facts"))
def fact_languages(spark, sf_dir):
    found = fa.page_languages(facts(spark, sf_dir), "(?iu)^(?:audio|language$)")
    return found.select("page_id", F.array_join("languages", ",").alias("languages"))


@query("fact_redact", oracle("""SELECT page_id, label, tie_key, NULL AS warning FROM v_facts WHERE label NOT IN ('Session token', 'Upload speed')
  UNION ALL SELECT DISTINCT page_id, NULL, NULL, 'sensitive_fact_redacted' FROM v_facts WHERE label = 'Session token'""", "v_facts"))
def fact_redact(spark, sf_dir):
    kept, warnings = fa.redact_facts(facts(spark, sf_dir))
    return kept.select("page_id", "label", "tie_key").unionByName(warnings, allowMissingColumns=True)


@query("category_lookup", oracle("""SELECT arrival_key, o.source, c.types_csv AS types FROM v_obs o JOIN v_categories c ON o.source = c.source AND CAST(o.media_id % 30 AS VARCHAR) = c.category_id""", "v_obs", "v_categories"))
def category_lookup(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").select(
        "arrival_key", "source", (F.col("media_id") % 30).cast("string").alias("category_id")
    )
    categories = view(spark, sf_dir, "v_categories").withColumnRenamed("types_csv", "types")
    return fa.categorize(rows, categories).select("arrival_key", "source", "types")


@query("category_slug", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'serial' WHEN 1 THEN 'documovie' WHEN 2 THEN 'movie' WHEN 3 THEN 'multserial' ELSE 'anime' END AS types FROM orders""")
def category_slug(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    slug = F.when(k == 0, "/Nashi_Seriali").when(k == 1, "Научное").when(k == 2, "/kino").when(k == 3, "/multiki").otherwise("/other")
    current = F.when(k == 3, F.array(F.lit("multserial"))).otherwise(F.array(F.lit("anime")))
    types = fa.category_types(current, slug)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(types, ",").alias("types"))


_DETAIL_SQL = """SELECT l.source, l.source_key, coalesce(l.observed_fields | d.observed_fields, l.observed_fields) AS observed_fields,
  CASE WHEN (d.observed_fields & 4) <> 0 THEN d.title ELSE l.title END AS title, CASE WHEN (d.observed_fields & 8) <> 0 THEN d.size_bytes ELSE l.size_bytes END AS size_bytes,
  CASE WHEN (d.observed_fields & 1024) <> 0 THEN d.quality ELSE l.quality END AS quality, coalesce(d.details_state, l.details_state) AS details_state,
  (SELECT string_agg(DISTINCT w, ',' ORDER BY w) FROM (SELECT unnest(string_split(l.voices || ',' || coalesce(d.voices, ''), ',')) AS w) WHERE w <> '') AS warnings
  FROM l {join} JOIN d USING (source, source_key)"""
_PAIRS_SQL = """base AS (SELECT source, source_key, arrival_key, observed_fields, title, size_bytes, quality, details_state, coalesce(voices_csv, '') AS voices FROM obs),
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_key ORDER BY arrival_key DESC) AS n FROM base WHERE details_state <> 'fetched') WHERE n = 1),
  d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_key ORDER BY arrival_key DESC) AS n FROM base WHERE details_state = 'fetched') WHERE n = 1)"""


def _pairs(spark, sf_dir):
    rows = obs(spark, sf_dir).select(
        "source", "source_key", "arrival_key", "observed_fields", "title", "size_bytes", "quality",
        "details_state", F.coalesce("voices", F.array().cast("array<string>")).alias("warnings"),
    )
    last = lambda r: fo.last_per_key(r, list(fo.KEY), "arrival_key").drop("arrival_key")
    return last(rows.where("details_state <> 'fetched'")), last(rows.where("details_state = 'fetched'"))


def _enriched(rows):
    return rows.withColumn("warnings", F.nullif(F.array_join(F.array_sort("warnings"), ","), F.lit("")))


@query("enrich_list_detail", sql(_DETAIL_SQL.format(join="LEFT"), _PAIRS_SQL))
def enrich_list_detail(spark, sf_dir):
    return _enriched(fa.enrich(*_pairs(spark, sf_dir)))


@query("enrich_only_detailed", sql(_DETAIL_SQL.format(join=""), _PAIRS_SQL))
def enrich_only_detailed(spark, sf_dir):
    return _enriched(fa.enrich(*_pairs(spark, sf_dir), keep_bare=False))


# --- nested JSON source ---------------------------------------------------------------------------

def _bodies(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    p = F.col("p_partkey").cast("int")
    value = lambda c: F.struct(c.alias("value"))
    kind = F.when(p % 7 == 0, "BOOK").when(p % 5 == 0, None).otherwise("tv")
    release = F.struct(
        p.alias("id"), F.when(kind.isNotNull(), value(kind)).alias("type"), (F.lit(1990) + F.col("p_size")).cast("int").alias("year"),
        F.struct(F.when(p % 9 == 0, " ").otherwise(F.col("p_name")).alias("main"), F.col("p_brand").alias("english")).alias("name"),
        F.when(p % 2 == 0, F.concat(F.lit("alias-"), p)).alias("alias"),
    )
    found = part.select(F.to_json(F.array(release, release)).alias("body"))
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    h = F.concat(F.md5(key.cast("string")), F.substring(F.md5(key.cast("string")), 1, 8))
    item = F.struct(
        key.cast("int").alias("id"), F.when(key % 3 == 0, None).when(key % 11 == 0, "bad").when(key % 13 == 0, F.lit("0" * 40)).otherwise(h).alias("hash"),
        F.round("l_extendedprice").cast("long").alias("size"), value(F.lit("WEBRip")).alias("type"), value(F.lit("1080p")).alias("quality"),
        F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper(h), F.lit("&tr=udp%3A%2F%2Ft.example%3A80")).alias("magnet"),
        F.col("l_quantity").cast("int").alias("seeders"), F.when(key % 2 == 0, F.col("l_linenumber")).alias("leechers"),
        F.lit("2024-01-01T00:00:00+00:00").alias("created_at"), F.concat(F.lit("label "), key).alias("label"),
    )
    return found, l.select(F.col("l_partkey").alias("release_id"), F.to_json(F.array(item)).alias("body"))


@query("json_release_flatten", """SELECT l_partkey || ':' || k AS source_key, CASE WHEN p_partkey % 9 = 0 THEN 'label ' || k ELSE p_name END AS title, h AS entity_hash,
  'magnet:?xt=urn:btih:' || h || '&tr=udp%3A%2F%2Ft.example%3A80' AS link, CAST(round(l_extendedprice) AS BIGINT) AS size_bytes, CAST(CASE WHEN k % 2 = 0 THEN l_linenumber ELSE 0 END AS INT) AS secondary_popularity,
  'https://json.example/release/' || CASE WHEN p_partkey % 2 = 0 THEN 'alias-' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END || '#item-' || k AS source_url,
  CASE WHEN k % 3 <> 0 AND k % 11 = 0 THEN 'explicit_hash_invalid' ELSE '' END AS warnings,
  CAST(1 + 2 + 4 + 8 + 16 + CASE WHEN k % 2 = 0 THEN 32 ELSE 0 END + 64 + CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 128 END + 256 + 512 + 1024 + 2048 AS BIGINT) AS observed_fields
  FROM (SELECT *, l_orderkey * 10 + l_linenumber AS k, concat(md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), substr(md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)), 1, 8)) AS h FROM lineitem)
  JOIN part ON p_partkey = l_partkey WHERE p_partkey % 7 <> 0 AND NOT (k % 3 <> 0 AND k % 11 <> 0 AND k % 13 = 0)""")
def json_release_flatten(spark, sf_dir):
    found, items = _bodies(spark, sf_dir)
    rows = release_items(releases(found), items, "https://json.example")
    return rows.select(
        "source_key", "title", "entity_hash", "link", "size_bytes", "secondary_popularity", "source_url",
        F.array_join("warnings", ",").alias("warnings"), "observed_fields",
    )
