"""Queries over result rows and canonical items: merge, search, filter, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from obscat.functions.text import search_tokens
from obscat.operators import fold as fo
from obscat.operators import merge as me
from obscat.operators import search as se
from obscat.operators import state as st
from obscat.operators import title_index as ti
from obscat.operators import validate as va
from obscat.operators.packing import ROWS
from obscat.operators.skew import numbered
from obscat.plans.fold_queries import ACC_SQL, GOLD_OUT, GOLD_STEPS, OBS_SQL, SNAP_SQL, gold_sql, golden, obs
from obscat.plans.registry import query
from obscat.plans.state_queries import MAPS_SQL, SUMMARY_SQL, override_maps
from obscat.schema import source_dimension
from obscat.session import shared_dir
from obscat.sources.views import AS_OF_LINEITEM, csv_array, oracle, view

_HITS_SQL = """hits AS (SELECT CASE source WHEN 'src_g' THEN 'src' ELSE source END AS source, arrival_key AS source_key, entity_hash AS item,
  title, popularity, secondary_popularity, size_bytes, fetched_at AS publish_date, voices_csv, languages_csv, quality, release_year,
  CASE WHEN media_id % 61 = 0 THEN 'magnet:?dn=none' ELSE concat('magnet:?xt=urn:btih:', upper(entity_hash),
    CASE WHEN media_id % 3 = 0 THEN concat('&dn=', replace(title, ' ', '%20')) ELSE '' END,
    CASE WHEN media_id % 4 = 0 THEN '' ELSE concat('&tr=https%3A%2F%2Ft', CAST(media_id % 6 AS VARCHAR(2)), '.example%2Fannounce',
      CASE WHEN media_id % 5 = 0 THEN '%3Fpasskey%3Dx' ELSE '' END) END) END AS link FROM v_obs)"""


def hits(spark, sf_dir):
    v = view(spark, sf_dir, "v_obs")
    rows = spark.sql("WITH v_obs AS (SELECT * FROM {v}), " + _HITS_SQL + " SELECT * FROM hits", v=v)
    return rows.select(
        *[c for c in rows.columns if c not in ("item", "voices_csv", "languages_csv")],
        csv_array("voices_csv").alias("voices"), csv_array("languages_csv").alias("languages"),
    )


_MERGE_SQL = _HITS_SQL + """,
  h AS (SELECT *, lower(item) AS hash, {'d': publish_date, 'p': source <> 'src_e', 'k': source_key, 's': source} AS rk,
    CASE WHEN contains(link, '&dn=') THEN replace(title, '%20', ' ') END AS dn,
    CASE WHEN contains(link, '&tr=') AND NOT contains(link, 'passkey') THEN regexp_extract(link, 'tr=([^&]*)', 1) END AS tr
    FROM hits WHERE link <> 'magnet:?dn=none'),
  g AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY rk DESC) AS pos FROM h),
  src AS (SELECT hash, list_reduce(list(source ORDER BY pos), lambda a, b: CASE WHEN contains(a, b) THEN a ELSE a || ', ' || b END) AS source
    FROM (SELECT hash, source, min(pos) AS pos FROM g GROUP BY hash, source) GROUP BY hash),
  voi AS (SELECT hash, string_agg(v, ' | ' ORDER BY pos) AS voices FROM (SELECT hash, lower(v) AS k, arg_min(v, pos) AS v, min(pos) AS pos
    FROM (SELECT hash, unnest(string_split(voices_csv, ',')) AS v, pos FROM g) WHERE v <> '' GROUP BY hash, lower(v)) GROUP BY hash),
  lan AS (SELECT hash, string_agg(v, ',' ORDER BY p) AS languages FROM (SELECT hash, lower(v) AS k, arg_min(v, p) AS v, min(p) AS p
    FROM (SELECT hash, unnest(string_split(languages_csv, ',')) AS v, pos * 100 + unnest(range(len(string_split(languages_csv, ',')))) AS p FROM g)
    WHERE v <> '' GROUP BY hash, lower(v)) GROUP BY hash),
  agg AS (SELECT hash, arg_min(title, pos) AS base_title, arg_min(popularity, pos) AS p0, arg_min(secondary_popularity, pos) AS q0,
    max(publish_date) AS publish_date, arg_min(link, pos) AS base_link, count(*) AS n_rows, arg_min(size_bytes, pos) AS size_bytes,
    arg_max(title, pos) FILTER (WHERE source = 'src_c') AS t, max(pos) FILTER (WHERE source = 'src_c') AS tpos,
    max(pos) FILTER (WHERE voices_csv <> '') AS vpos, max(popularity) FILTER (WHERE source <> 'src_e') AS p1,
    max(secondary_popularity) FILTER (WHERE source <> 'src_e') AS q1, max(pos) FILTER (WHERE tr IS NOT NULL) AS trpos,
    min(pos) FILTER (WHERE dn IS NOT NULL) AS dnpos, arg_min(dn, pos) FILTER (WHERE dn IS NOT NULL) AS dn,
    string_agg(DISTINCT '&tr=' || tr, '' ORDER BY '&tr=' || tr) AS trs FROM g GROUP BY hash),
  merged AS (SELECT hash AS entity_hash, src.source,
    CASE WHEN tpos IS NOT NULL AND (tpos > 1 OR coalesce(vpos, 0) > 1) THEN t || coalesce(' | ' || voices, '') ELSE base_title END AS title,
    greatest(p0, p1) AS popularity, greatest(q0, q1) AS secondary_popularity, publish_date, size_bytes, n_rows,
    CASE WHEN coalesce(trpos, 0) > 1 OR coalesce(dnpos, 0) > 1 THEN 'magnet:?xt=urn:btih:' || hash || coalesce(trs, '') || coalesce('&dn=' || replace(dn, ' ', '%20'), '')
      ELSE base_link END AS link, coalesce(voices, '') AS voices, coalesce(languages, '') AS languages
    FROM agg JOIN src USING (hash) LEFT JOIN voi USING (hash) LEFT JOIN lan USING (hash))"""


def merged(spark, sf_dir):
    return me.merge_duplicates(hits(spark, sf_dir), title_source="src_c", demoted="src_e")


@query("merge_duplicates", oracle("+" + _MERGE_SQL + " SELECT * FROM merged", "v_obs"))
def merge_duplicates(spark, sf_dir):
    return merged(spark, sf_dir).select(
        "entity_hash", "source", "title", "popularity", "secondary_popularity", "publish_date",
        "size_bytes", "n_rows", "link", F.array_join("voices", " | ").alias("voices"),
        F.array_join("languages", ",").alias("languages"),
    )


@query("merge_sources_list", oracle("+" + _MERGE_SQL + " SELECT hash AS entity_hash, source AS sources FROM src", "v_obs"))
def merge_sources_list(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumn("_hash", F.lower(F.regexp_extract("link", "btih:([0-9A-F]{40})", 1)))
    rows = rows.where(F.col("_hash") != "").withColumn("_rank", me.arrival_rank("src_e"))
    return me.source_names(rows).select(F.col("_hash").alias("entity_hash"), "sources")


@query("dedupe_first", oracle("SELECT source_key, arrival_key, title FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY fetched_at, arrival_key) AS n FROM v_obs) WHERE n = 1", "v_obs"))
def dedupe_first(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").select("source_key", "fetched_at", "arrival_key", "title")
    return fo.first_per_key(rows, ["source_key"], "fetched_at", "arrival_key").drop("fetched_at")


@query("dedupe_last", oracle("SELECT url, arrival_key, title FROM (SELECT lower(source_url) AS url, *, row_number() OVER (PARTITION BY lower(source_url) ORDER BY arrival_key DESC) AS n FROM v_obs) WHERE n = 1", "v_obs"))
def dedupe_last(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").select(F.lower("source_url").alias("url"), "arrival_key", "title")
    return fo.last_per_key(rows, ["url"], "arrival_key")


@query("top1_per_source", oracle("SELECT source, source_key, popularity FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY popularity DESC, secondary_popularity DESC, source_key, arrival_key) AS n FROM v_obs) WHERE n = 1", "v_obs"))
def top1_per_source(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").select("source", "source_key", "popularity", "secondary_popularity")
    return me.most_popular(rows, ["source"]).select("source", "source_key", "popularity")


@query("popularity_order", oracle(
    "SELECT arrival_key, row_number() OVER (ORDER BY popularity DESC, secondary_popularity DESC, source_key, arrival_key) AS position FROM v_obs", "v_obs"))
def popularity_order(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").withColumn("_all", F.lit(0))
    falling = F.coalesce(F.bitwise_not(F.col("popularity").cast("long")), F.lit((1 << 63) - 1))
    return numbered(rows, ["_all"], [*me.popularity_order(), F.col("arrival_key")], "position", falling).select("arrival_key", "position")


@query("union_sources", oracle("SELECT source, arrival_key, CASE WHEN source = 'src_a' THEN quality END AS quality FROM v_obs", "v_obs"))
def union_sources(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs")
    first = rows.where("source = 'src_a'").select("source", "arrival_key", "quality")
    rest = [rows.where(F.col("source") == s).select("source", "arrival_key") for s in ("src_b", "src_c", "src_d", "src_e", "src_f", "src_g")]
    return me.union_sources([first, *rest])


@query("distinct_items", oracle("SELECT DISTINCT entity_hash, release_year FROM v_obs", "v_obs"))
def distinct_items(spark, sf_dir):
    return view(spark, sf_dir, "v_obs").select("entity_hash", "release_year").distinct()


@query("warnings_union", oracle("""SELECT source_key, string_agg(DISTINCT w, ',' ORDER BY w) AS warnings FROM (SELECT source_key, unnest(string_split(languages_csv, ',')) AS w FROM v_obs
  UNION ALL SELECT source_key, unnest(string_split(types_csv, ',')) FROM v_obs) WHERE w <> '' GROUP BY source_key""", "v_obs"))
def warnings_union(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").select(
        "source_key", F.explode(F.array_union(csv_array("languages_csv"), csv_array("types_csv"))).alias("w")
    )
    merged_ = rows.groupBy("source_key").agg(F.array_sort(F.collect_set("w")).alias("w"))
    return merged_.select("source_key", F.array_join("w", ",").alias("warnings"))


# --- search -------------------------------------------------------------------------------

_MEDIA = 12


@query("search_by_media", gold_sql(
    f"SELECT {GOLD_OUT} FROM golden WHERE entity_hash IN (SELECT entity_hash FROM acc WHERE media_id = {_MEDIA}) "
    "ORDER BY popularity DESC, entity_hash LIMIT 500"))
def search_by_media(spark, sf_dir):
    links = fo.media_links(fo.accepted(fo.keys_of_media(obs(spark, sf_dir), _MEDIA)), query="source_url")
    return se.by_media(golden(spark, sf_dir), links, _MEDIA).select(*GOLD_OUT.split(", "))


@query("search_by_title", gold_sql(
    f"SELECT {GOLD_OUT} FROM golden WHERE contains(lower(title), '77') OR contains(lower(coalesce(name, '')), '77') "
    "OR contains(lower(title), 'v7') OR contains(lower(coalesce(name, '')), 'v7') ORDER BY popularity DESC, entity_hash LIMIT 2000"))
def search_by_title(spark, sf_dir):
    return se.by_title(golden(spark, sf_dir), "77  V7 v7 x %7_7", 5000).select(*GOLD_OUT.split(", "))


@query("search_topk", gold_sql("SELECT entity_hash, popularity, title FROM golden ORDER BY popularity DESC, entity_hash LIMIT 500"))
def search_topk(spark, sf_dir):
    return se.top_items(golden(spark, sf_dir)).select("entity_hash", "popularity", "title")


_ASKED_SQL = """asked AS (SELECT s_suppkey AS query_id, concat('BRAND#', CAST(s_suppkey % 30 AS VARCHAR(4)), '  ', CASE s_suppkey % 4 WHEN 0 THEN 'uhd'
  WHEN 1 THEN '19%7_7' WHEN 2 THEN 'x' ELSE 'p ' END, ' ', CAST(s_suppkey % 90 + 10 AS VARCHAR(4))) AS query FROM {supplier})"""


@query("search_many_titles", oracle("+" + _ASKED_SQL.format(supplier="supplier") + """, hits AS (SELECT DISTINCT query_id, item_id FROM
  (SELECT query_id, unnest(list_filter(list_transform(string_split(query, ' '), lambda w: lower(regexp_replace(w, '[%_]', '', 'g'))), lambda w: length(w) >= 2)) AS token FROM asked)
  JOIN v_titles ON contains(lower(title), token)), ranked AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY item_id * 31 % 1000 DESC, item_id) AS rank FROM hits)
  SELECT query_id, item_id, rank FROM ranked WHERE rank <= 20""", "v_titles"))
def search_many_titles(spark, sf_dir):
    from obscat.sources.views import table

    asked = spark.sql("WITH " + _ASKED_SQL + " SELECT * FROM asked", supplier=table(spark, sf_dir, "supplier"))
    titles = view(spark, sf_dir, "v_titles").withColumn("popularity", F.col("item_id") * 31 % 1000)
    return se.many_titles(titles, asked, item="item_id", limit=20)


_INDEXED_SQL = """asked AS (SELECT s_suppkey AS query_id, concat('BRAND#', CAST(s_suppkey % 30 AS VARCHAR(4)), ' ', CASE s_suppkey % 4 WHEN 0 THEN 'rip'
  WHEN 1 THEN 'hd' WHEN 2 THEN 's0' ELSE 'zzqq' END, ' ', CAST(s_suppkey % 90 + 10 AS VARCHAR(4))) AS query FROM {supplier} WHERE s_suppkey > 0)"""


@query("search_title_index", oracle("+" + _INDEXED_SQL.format(supplier="supplier") + """, hits AS (SELECT DISTINCT query_id, item_id FROM
  (SELECT query_id, unnest(string_split(lower(query), ' ')) AS token FROM asked) JOIN v_titles ON contains(lower(title), token)),
  ranked AS (SELECT query_id, item_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY item_id * 31 % 1000 DESC, item_id) AS rank FROM hits)
  SELECT query_id, item, rank FROM ranked WHERE rank <= 50""", "v_titles"))
def search_title_index(spark, sf_dir):
    from obscat.sources.views import table

    folder = shared_dir(spark, "titles")
    asked = spark.sql("WITH " + _INDEXED_SQL + " SELECT * FROM asked", supplier=table(spark, sf_dir, "supplier"))
    titles = view(spark, sf_dir, "v_titles").select("item_id", "title", (F.col("item_id") * 31 % 1000).alias("popularity"))
    index = ti.build(titles, f"{folder}/index", item="item_id", block=200)
    return ti.search(index, asked, f"{folder}/search", limit=50)


_FILTER_OUT = "entity_hash, popularity, release_year, quality"


@query("filter_all", gold_sql(
    f"SELECT {_FILTER_OUT} FROM golden WHERE list_contains(string_split(types, ','), 'movie') AND contains(source, 'rc_') "
    "AND quality = 1080 AND list_contains(string_split(lower(voices), ','), 'studio 1') AND list_contains(string_split(seasons, ','), '2')"))
def filter_all(spark, sf_dir):
    found = se.apply_filters(
        golden(spark, sf_dir), type="movie", source="RC_", year=1999, quality=1080,
        voice="studio 1", season=2, is_serial=2,
    )
    return found.select(*_FILTER_OUT.split(", "))


@query("filter_array", gold_sql(f"SELECT {_FILTER_OUT} FROM golden WHERE list_contains(string_split(types, ','), 'serial') AND release_year = 1999"))
def filter_array(spark, sf_dir):
    return se.apply_filters(golden(spark, sf_dir), type="serial", year=1999).select(*_FILTER_OUT.split(", "))


@query("filter_source_ilike", gold_sql(f"SELECT {_FILTER_OUT}, video_type FROM golden WHERE contains(source, '_b') AND video_type = 'BDRip'"))
def filter_source_ilike(spark, sf_dir):
    found = se.apply_filters(golden(spark, sf_dir), source="_B", video_type="BDRip")
    return found.select(*_FILTER_OUT.split(", "), "video_type")


@query("enabled_sources", oracle("+" + _MERGE_SQL + " SELECT hash AS entity_hash, source FROM src WHERE contains(source, 'src_b') OR contains(source, 'src_f')", "v_obs"))
def enabled_sources(spark, sf_dir):
    off = ("src_a", "src_c", "src_d", "src_e", "src_g")
    dimension = source_dimension(spark, disabled=off)
    return va.enabled_sources(merged(spark, sf_dir), dimension).select("entity_hash", "source")


@query("allowed_types_forall", oracle(
    "SELECT arrival_key, source_key FROM v_obs WHERE types_csv <> 'movie,Anime' AND languages_csv <> ''", "v_obs"))
def allowed_types_forall(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs").withColumn(
        "kinds", F.when(F.col("languages_csv") == "", F.array().cast("array<string>")).when(
            F.col("types_csv") == "movie,Anime", F.array(F.lit("movie"), F.lit("music"))
        ).otherwise(csv_array("types_csv")),
    )
    return va.allowed_types(rows, "kinds").select("arrival_key", "source_key")


@query("sort_modes", gold_sql(" UNION ALL ".join(
    f"SELECT '{mode}' AS mode, entity_hash, row_number() OVER (ORDER BY {column} DESC, entity_hash) AS position FROM golden"
    for mode, column in (("sid", "popularity"), ("pir", "secondary_popularity"), ("size", "size_bytes"), ("other", "publish_date")))))
def sort_modes(spark, sf_dir):
    items = golden(spark, sf_dir).select("entity_hash", *dict.fromkeys(se.SORTS.values()))
    return se.sort_positions(items, ("sid", "pir", "size", "other"))


@query("catalog_projection", gold_sql(
    "SELECT entity_hash, source, size_bytes, regexp_replace(regexp_replace(printf('%.2f', round(CASE WHEN size_bytes >= 1073741824 THEN size_bytes / 1073741824.0 "
    "WHEN size_bytes >= 1048576 THEN size_bytes / 1048576.0 WHEN size_bytes >= 1024 THEN size_bytes / 1024.0 ELSE size_bytes END, 2)), '0+$', ''), '\\.$', '') || "
    "CASE WHEN size_bytes >= 1073741824 THEN ' GB' WHEN size_bytes >= 1048576 THEN ' MB' WHEN size_bytes >= 1024 THEN ' KB' ELSE ' B' END AS size_label, "
    "coalesce(release_year, 0) AS release_year, coalesce(quality, 0) AS quality, voices, "
    f"TIMESTAMP '{AS_OF_LINEITEM}' AS updated_at, title <> '' AS parsed, CAST(nullif(regexp_extract(title, '\\b((19|20)\\d{{2}})\\b', 1), '') AS INT) AS parsed_year, "
    "nullif(lower(regexp_extract(title, '\\b(\\d{3,4}[pi]|4k)\\b', 1)), '') AS parsed_resolution FROM golden"))
def catalog_projection(spark, sf_dir):
    rows = se.catalog_rows(golden(spark, sf_dir))
    return rows.select(
        "entity_hash", "source", "size_bytes", "size_label", "release_year", "quality",
        F.nullif(F.array_join("voices", ","), F.lit("")).alias("voices"),
        "updated_at", F.col("parsed_info").isNotNull().alias("parsed"), F.col("parsed_info.year").alias("parsed_year"), F.col("parsed_info.resolution").alias("parsed_resolution"),
    )


@query("result_projection", oracle("""SELECT md5(title) AS key, title, strftime(TIMESTAMP '2024-01-02 03:04:05', '%Y-%m-%dT%H:%M:%SZ') AS publish_date,
  (CASE WHEN regexp_matches(title, '\\d{3,4}p') THEN 'quality=' || regexp_extract(title, '(\\d{3,4}p)', 1) || ';' ELSE '' END) ||
  'source=' || regexp_extract(title, '(BDRip|WEB-DLRip|UHD BDRemux|HDRip)', 1) ||
  (CASE WHEN regexp_extract(title, '\\((\\d{4})\\)', 1) BETWEEN '1900' AND '2099' THEN ';year=' || regexp_extract(title, '\\((\\d{4})\\)', 1) ELSE '' END) AS tags
  FROM v_titles""", "v_titles"))
def result_projection(spark, sf_dir):
    items = view(spark, sf_dir, "v_titles").select(
        F.lit(None).cast("string").alias("entity_hash"), F.lit(None).cast("string").alias("source_url"),
        F.lit("src_a").alias("source"), "title", "link", F.lit(1).alias("popularity"),
        F.lit(1).alias("secondary_popularity"), F.lit(5).alias("size_bytes"),
        F.expr("TIMESTAMP_NTZ '2024-01-02 03:04:05'").alias("publish_date"),
    )
    tags = F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["kind"], t["value"])), ";")
    return se.result_rows(items).select(F.md5("title").alias("key"), "title", "publish_date", tags.alias("tags"))


@query("attach_overrides", oracle("+" + MAPS_SQL + "," + SUMMARY_SQL + """, res AS (SELECT DISTINCT CASE WHEN media_id % 3 = 0 THEN 'https://x/' || CAST(media_id AS VARCHAR)
  ELSE upper(concat(md5(CAST(media_id AS VARCHAR)), substr(md5(CAST(media_id AS VARCHAR)), 1, 8))) END AS id FROM v_query_log)
  SELECT id, season_count, file_count, primary_source FROM res LEFT JOIN summary ON lower(res.id) = summary.hash""", "v_override_log", "v_query_log"))
def attach_overrides(spark, sf_dir):
    media = view(spark, sf_dir, "v_query_log").select(F.col("media_id").cast("string").alias("m"), "media_id").distinct()
    hashed = F.upper(F.concat(F.md5("m"), F.substring(F.md5("m"), 1, 8)))
    results = media.select(
        F.when(F.col("media_id") % 3 == 0, F.concat(F.lit("https://x/"), "m")).otherwise(hashed).alias("id")
    )
    attached = se.attach_overrides(results, st.override_summaries(override_maps(spark, sf_dir)))
    return attached.select("id", "season_count", "file_count", "primary_source")


_EVENT_SQL = """'{"id":"' || entity_hash || '","title":"' || title || '","tracker":"' || source || '","sizeBytes":' || size_bytes || ',"sizeLabel":"' || regexp_replace(regexp_replace(printf('%.2f', round(CASE WHEN size_bytes >= 1073741824 THEN size_bytes / 1073741824.0
  WHEN size_bytes >= 1048576 THEN size_bytes / 1048576.0 WHEN size_bytes >= 1024 THEN size_bytes / 1024.0 ELSE size_bytes END, 2)), '0+$', ''), '\\.$', '') ||
  CASE WHEN size_bytes >= 1073741824 THEN ' GB' WHEN size_bytes >= 1048576 THEN ' MB' WHEN size_bytes >= 1024 THEN ' KB' ELSE ' B' END ||
  '","seeders":' || popularity || ',"leechers":' || secondary_popularity || ',"publishDate":"' || strftime(publish_date, '%Y-%m-%dT%H:%M:%SZ') ||
  '","magnetUri":"' || link || '","link":"' || source_url || '","tags":[' || CASE WHEN regexp_matches(title, '\\b(19|20)\\d{2}\\b') THEN '{"kind":"year","value":"' || regexp_extract(title, '\\b((19|20)\\d{2})\\b', 1) || '"}' ELSE '' END || ']}'"""


@query("search_events", gold_sql("""SELECT source, batch, count(*) AS n_results, '{"type":"batch","source":"' || source || '","results":[' || string_agg(""" + _EVENT_SQL + """,
  ',' ORDER BY entity_hash) || ']}' AS line
  FROM (SELECT golden.*, CAST('0x' || substr(md5(entity_hash), 1, 8) AS BIGINT) % CAST(ceil(count(*) OVER (PARTITION BY source) / 100.0) AS BIGINT) AS batch FROM golden)
  GROUP BY source, batch UNION ALL SELECT NULL, NULL, 0, '{"type":"done"}'"""))
def search_events(spark, sf_dir):
    return se.result_events(se.result_rows(golden(spark, sf_dir)), 100)


_REQUEST_SQL = """ SELECT id, title, popularity, size_bytes, position, season_count, file_count FROM (
  SELECT entity_hash AS id, title, popularity, size_bytes, row_number() OVER (ORDER BY size_bytes DESC, entity_hash) AS position
  FROM (SELECT * FROM golden WHERE contains(lower(title), 'item') ORDER BY popularity DESC, entity_hash LIMIT 300) WHERE quality = 1080)
  LEFT JOIN (SELECT hash, season_count, file_count FROM summary) ON id = hash"""


@query("search_request", oracle(
    "+" + ", ".join([OBS_SQL, ACC_SQL, SNAP_SQL, *GOLD_STEPS, MAPS_SQL, SUMMARY_SQL]) + _REQUEST_SQL, "v_obs", "v_override_log"))
def search_request(spark, sf_dir):
    found = se.search_request(
        golden(spark, sf_dir, ROWS), st.override_summaries(override_maps(spark, sf_dir)), "item x", sort="size", limit=300, quality=1080)
    return found.select("id", "title", "popularity", "size_bytes", "position", "season_count", "file_count")


@query("query_tokens", oracle("""SELECT item_id, array_to_string(list_filter(string_split(title, ' '), lambda w: length(w) >= 2), ' ') AS tokens FROM v_titles""", "v_titles"))
def query_tokens(spark, sf_dir):
    rows = view(spark, sf_dir, "v_titles")
    return rows.select("item_id", F.array_join(search_tokens("title"), " ").alias("tokens"))
