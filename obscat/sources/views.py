"""Views over the driver tables, as SQL text that Spark and DuckDB both accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_EVENTS = "2024-02-01 00:00:00"
AS_OF_LINEITEM = "2002-01-01 00:00:00"

VIEWS: dict[str, str] = {}

VIEWS["v_obs"] = """
SELECT
  CASE l_suppkey % 7 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' WHEN 2 THEN 'src_c' WHEN 3 THEN 'src_d'
    WHEN 4 THEN 'src_e' WHEN 5 THEN 'src_f' ELSE 'src_g' END AS source,
  CAST(l_orderkey AS VARCHAR(20)) AS source_key,
  concat(md5(CAST(l_partkey AS VARCHAR(20))), substr(md5(CAST(l_partkey AS VARCHAR(20))), 1, 8)) AS entity_hash,
  l_shipdate AS fetched_at,
  md5(concat_ws('|', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)),
    CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)),
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)))) AS arrival_key,
  ((l_orderkey * 31 + l_linenumber * 7 + l_partkey * 13) % 65536) AS observed_fields,
  CASE WHEN l_returnflag = 'A' THEN 'fetched' WHEN l_returnflag = 'R' THEN 'partial'
    WHEN l_linestatus = 'F' THEN 'not_required' ELSE 'failed' END AS details_state,
  CAST(round(l_extendedprice * 1000) AS BIGINT) AS size_bytes,
  CAST(l_quantity AS INT) AS popularity,
  CAST(round(l_discount * 100) AS INT) AS secondary_popularity,
  concat('Item ', CAST(l_partkey AS VARCHAR(20)), ' v', CAST(l_linenumber AS VARCHAR(20))) AS title,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('Name ', CAST(l_partkey % 50 AS VARCHAR(20))) END AS name,
  CAST(1980 + l_partkey % 45 AS INT) AS release_year,
  CAST(CASE l_linenumber % 3 WHEN 0 THEN 720 WHEN 1 THEN 1080 ELSE 2160 END AS INT) AS quality,
  CASE l_suppkey % 3 WHEN 0 THEN 'movie,Anime' WHEN 1 THEN 'anime' ELSE 'serial,movie' END AS types_csv,
  CASE l_orderkey % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'RU,en' WHEN 2 THEN 'en' ELSE '' END AS languages_csv,
  CAST(1 + l_linenumber % 4 AS INT) AS season,
  l_orderkey % 997 AS media_id,
  concat('https://', CAST(l_suppkey % 7 AS VARCHAR(2)), '.example/t/', CAST(l_orderkey AS VARCHAR(20))) AS source_url,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('Studio ', CAST(l_suppkey % 5 AS VARCHAR(2))) ELSE '' END AS voices_csv,
  CASE l_partkey % 3 WHEN 0 THEN 'BDRip' WHEN 1 THEN 'WEB-DL' ELSE NULL END AS video_type,
  concat('d', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS details,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_shipdate END AS publish_date
FROM {lineitem}
"""

VIEWS["v_payloads"] = """
SELECT
  CASE l_suppkey % 7 WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' WHEN 2 THEN 'src_c' WHEN 3 THEN 'src_d'
    WHEN 4 THEN 'src_e' WHEN 5 THEN 'src_f' ELSE 'src_g' END AS source,
  CAST(l_orderkey - l_orderkey % 8 AS VARCHAR(20)) AS source_key, l_shipdate AS fetched_at,
  md5(concat_ws('|', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)),
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)))) AS arrival_key,
  CAST(3 AS BIGINT) AS observed_fields,
  CASE WHEN l_returnflag = 'A' THEN 'fetched' WHEN l_returnflag = 'R' THEN 'partial' WHEN l_linestatus = 'F' THEN 'not_required' ELSE 'failed' END AS details_state,
  CASE l_partkey % 9 WHEN 0 THEN '[1,2]' WHEN 1 THEN NULL WHEN 2 THEN '{{"list":' WHEN 3 THEN concat('{{"list":{{"id":', CAST(l_orderkey AS VARCHAR(20)), '}}}}')
    WHEN 4 THEN concat('{{"details":null,"unmapped":{{"s":', CAST(l_suppkey % 5 AS VARCHAR(4)), '}},"warnings":["late","w', CAST(l_linenumber AS VARCHAR(4)), '"," "]}}')
    WHEN 5 THEN concat('{{"details":{{"deep":{{"x":[1,', CAST(l_linenumber AS VARCHAR(4)), ']}},"n":', CAST(l_linenumber AS VARCHAR(4)), '}},"parserVersion":"q"}}')
    ELSE concat('{{"details":{{"n":', CAST(l_linenumber AS VARCHAR(4)), '}},"list":{{"id":', CAST(l_orderkey AS VARCHAR(20)), ',"t":"a b"}},"parserVersion":"p', CAST(l_suppkey % 3 AS VARCHAR(4)),
      '","schemaVersion":', CAST(1 + l_partkey % 2 AS VARCHAR(4)), ',"unmapped":{{"a":', CAST(l_linenumber AS VARCHAR(4)), ',"s":"x"}},"warnings":["w', CAST(l_suppkey % 4 AS VARCHAR(4)), '"]}}')
    END AS payload
FROM {lineitem}
"""

VIEWS["v_titles"] = """
SELECT
  p_partkey AS item_id,
  concat(p_name, ' / ', p_brand, ' (', CAST(1970 + p_size AS VARCHAR(4)), ') ',
    CASE p_partkey % 4 WHEN 0 THEN 'BDRip 1080p' WHEN 1 THEN 'WEB-DLRip 720p' WHEN 2 THEN 'UHD BDRemux 2160p' ELSE 'HDRip' END,
    ' S0', CAST(1 + p_partkey % 3 AS VARCHAR(2)), '-0', CAST(1 + p_partkey % 5 AS VARCHAR(2))) AS title,
  concat('magnet:?xt=urn:btih:', upper(concat(md5(CAST(p_partkey AS VARCHAR(20))), substr(md5(CAST(p_partkey AS VARCHAR(20))), 1, 8))),
    '&dn=', replace(p_name, ' ', '%20'), '&tr=https%3A%2F%2Ft', CAST(p_partkey % 6 AS VARCHAR(2)), '.example%2Fannounce',
    CASE WHEN p_partkey % 11 = 0 THEN '%3Fpasskey%3Dx' ELSE '' END) AS link,
  CASE WHEN p_partkey % 13 = 0 THEN 'zz' WHEN p_partkey % 17 = 0 THEN md5('other')
    ELSE concat(md5(CAST(p_partkey AS VARCHAR(20))), substr(md5(CAST(p_partkey AS VARCHAR(20))), 1, 8)) END AS explicit_hash,
  concat(CAST(p_size AS VARCHAR(4)), CASE p_partkey % 3 WHEN 0 THEN ',5 ГБ' WHEN 1 THEN '.25 MB' ELSE ' TB' END) AS size_text,
  concat(CAST(1 + p_size % 28 AS VARCHAR(2)), CASE p_partkey % 3 WHEN 0 THEN ' мая ' WHEN 1 THEN ' декабря ' ELSE ' никогда ' END,
    CAST(2000 + p_size % 25 AS VARCHAR(4))) AS date_text
FROM {part}
"""

VIEWS["v_outcomes"] = """
SELECT
  user_id AS media_id, event_id AS run_id, ts,
  CASE event_type WHEN 'click' THEN 'src_a' WHEN 'view' THEN 'src_b' WHEN 'signup' THEN 'src_c'
    WHEN 'purchase' THEN 'src_d' ELSE 'src_e' END AS source,
  CASE event_id % 7 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'empty' WHEN 2 THEN 'partial' WHEN 3 THEN 'timedout'
    WHEN 4 THEN 'failed' WHEN 5 THEN 'disabled' ELSE 'succeeded' END AS status,
  CASE event_id % 7 WHEN 3 THEN 'timeout' WHEN 4 THEN 'transport' ELSE NULL END AS error_code,
  CASE WHEN event_id % 7 = 6 THEN 'invalid_source' ELSE NULL END AS write_error_code
FROM {events}
"""

VIEWS["v_query_log"] = """
SELECT user_id AS media_id, concat('query ', event_type) AS query, ts, event_id,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS is_refresh, CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS refresh_ok
FROM {events}
"""

VIEWS["v_subscription_log"] = """
SELECT concat('u', CAST(user_id % 40 AS VARCHAR(4))) AS uid, event_id % 97 AS media_id,
  CASE WHEN event_id % 2 = 0 THEN 'tv' ELSE 'movie' END AS media,
  CASE WHEN event_type = 'error' THEN 'unsubscribe' ELSE 'subscribe' END AS action, ts, event_id
FROM {events}
"""

VIEWS["v_cursor_log"] = """
SELECT CASE WHEN event_id % 3 = 0 THEN 'MOVIE' ELSE 'series' END AS media_type, user_id AS media_id,
  CASE WHEN event_id % 9 = 0 THEN ' ' ELSE concat('Title ', event_type) END AS title,
  CAST(floor(value) AS INT) - 5 AS progress_seconds, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS action, ts, event_id
FROM {events}
"""

VIEWS["v_override_log"] = """
SELECT concat(md5(CAST(user_id AS VARCHAR(20))), substr(md5(CAST(user_id AS VARCHAR(20))), 1, 8)) AS hash,
  CASE WHEN event_id % 4 = 0 THEN 'file' ELSE 'season' END AS map_kind,
  CASE WHEN event_id % 6 = 5 THEN '_' ELSE CAST(event_id % 6 AS VARCHAR(2)) END AS map_key,
  CASE WHEN event_type = 'error' THEN 'remove' WHEN event_id % 50 = 1 THEN 'replace' ELSE 'put' END AS action,
  CAST(1 + event_id % 9 AS INT) AS season, CAST(event_id % 25 AS INT) - 12 AS episode_offset,
  (event_id % 25) * 1000 + (event_id % 2) * 500 AS episode_thousandths,
  CASE WHEN event_id % 3 = 0 THEN 'pin' ELSE 'anchor' END AS file_mode,
  CASE WHEN event_id % 16 = 0 THEN concat('w', CAST(user_id AS VARCHAR(20)), ',e', CAST(event_id % 7 AS VARCHAR(20)), ',p', CAST(event_id % 11 AS VARCHAR(20))) END AS target_ids,
  CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN concat(CAST(event_id % 6 AS VARCHAR(20)), ',f', CAST(event_id % 4 AS VARCHAR(20))) END AS scope_ids,
  CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END AS has_target, ts, event_id
FROM {events}
"""

VIEWS["v_facts"] = """
SELECT l_orderkey AS page_id, l_linenumber AS seq,
  CASE l_partkey % 8 WHEN 0 THEN 'Audio' WHEN 1 THEN 'audio' WHEN 2 THEN 'Quality' WHEN 3 THEN 'Year' WHEN 4 THEN 'Upload speed'
    WHEN 5 THEN 'Session token' WHEN 6 THEN 'Language' ELSE 'Size' END AS label,
  CASE l_partkey % 8 WHEN 2 THEN '1080p' WHEN 3 THEN 'in 1999' WHEN 6 THEN 'Русский, English; рус' WHEN 7 THEN '8.5 GB'
    ELSE concat('value ', CAST(l_suppkey % 5 AS VARCHAR(2))) END AS value,
  md5(concat_ws('|', CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR(20)))) AS tie_key
FROM {lineitem}
"""

VIEWS["v_categories"] = """
SELECT CASE n_regionkey WHEN 0 THEN 'src_a' WHEN 1 THEN 'src_b' WHEN 2 THEN 'src_c' WHEN 3 THEN 'src_d' ELSE 'src_e' END AS source,
  CAST(n_nationkey AS VARCHAR(4)) AS category_id,
  CASE n_nationkey % 4 WHEN 0 THEN 'movie' WHEN 1 THEN 'serial' WHEN 2 THEN 'multfilm,multserial' ELSE 'other' END AS types_csv
FROM {nation}
"""

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


#: Tables of fewer bytes are read by however few tasks their files allow.
SPREAD_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; dealt out anew where it is not tiny and its files can feed fewer tasks than there are cores.

    A table of many files or row groups is read as it lies.
    """
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return rows.repartition(cores) if size >= SPREAD_BYTES else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """``body`` prefixed with the named views as common table expressions."""
    plain = {t: t for t in TABLES}
    parts = [f"{name} AS ({VIEWS[name].format(**plain)})" for name in names]
    return f"WITH {', '.join(parts)}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().lstrip('+')}"


def csv_array(column: str):
    """Comma-joined text to an array, empty text to an empty array."""
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(
        F.split(column, ",")
    )


def observations(raw: DataFrame) -> DataFrame:
    """``v_obs`` rows in the observation layout, facts kept only where observed."""
    from obscat.operators.fold import sparse

    return sparse(
        raw.select(
            "source", "source_key", "source_url", "entity_hash",
            F.concat(F.lit("magnet:?xt=urn:btih:"), "entity_hash").alias("link"),
            "title", "name", F.lit(None).cast("string").alias("original_name"),
            "size_bytes", "popularity", "secondary_popularity", "publish_date",
            "release_year", "quality", "video_type",
            csv_array("types_csv").alias("types"),
            csv_array("languages_csv").alias("languages"),
            csv_array("voices_csv").alias("voices"),
            F.array("season").alias("seasons"),
            "observed_fields", "details_state",
            F.lit(None).cast("timestamp_ntz").alias("source_updated_at"),
            "fetched_at", "details", "media_id", "arrival_key",
        )
    )
