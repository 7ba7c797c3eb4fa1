"""Queries over the change-log tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from obscat.functions.text import grouping_key
from obscat.operators import state as st
from obscat.operators import validate as va
from obscat.plans.registry import query
from obscat.sources.views import AS_OF_EVENTS, oracle, table, view

MAPS_SQL = """chg AS (SELECT *, {'t': ts, 'e': event_id} AS at_ FROM v_override_log),
  rep AS (SELECT hash, max(at_) AS at_ FROM chg WHERE action = 'replace' AND map_kind = 'season' GROUP BY hash),
  lastc AS (SELECT *, row_number() OVER (PARTITION BY hash, map_kind, map_key ORDER BY ts DESC, event_id DESC) AS n FROM chg),
  entries AS (SELECT lastc.* FROM lastc LEFT JOIN rep USING (hash) WHERE n = 1 AND action <> 'remove' AND (map_kind = 'file' OR rep.at_ IS NULL OR lastc.at_ >= rep.at_)),
  hashes AS (SELECT hash, max(ts) AS updated_at FROM chg GROUP BY hash HAVING bool_or(action <> 'remove')),
  maps AS (SELECT hash, updated_at,
    coalesce((SELECT string_agg(map_key || '=' || season || '/' || episode_offset, ',' ORDER BY map_key) FROM entries e WHERE e.hash = h.hash AND map_kind = 'season'), '') AS season_map,
    coalesce((SELECT string_agg(map_key || '=' || season || '/' || episode_thousandths || '/' || file_mode || '/' || coalesce(target_ids, '') || '/' || coalesce(scope_ids, ''), ';' ORDER BY map_key) FROM entries e WHERE e.hash = h.hash AND map_kind = 'file'), '') AS file_map
    FROM hashes h)"""
SUMMARY_SQL = """summary AS (SELECT hash, CAST(count(*) FILTER (WHERE map_kind = 'season') AS INT) AS season_count, CAST(count(*) FILTER (WHERE map_kind = 'file') AS INT) AS file_count,
  CASE WHEN count(*) FILTER (WHERE map_kind = 'season') = 1 THEN max(map_key) FILTER (WHERE map_kind = 'season') END AS primary_source,
  CASE WHEN count(*) FILTER (WHERE map_kind = 'season') = 1 THEN max(season) FILTER (WHERE map_kind = 'season') END AS primary_season,
  CASE WHEN count(*) FILTER (WHERE map_kind = 'season') = 1 THEN max(episode_offset) FILTER (WHERE map_kind = 'season') END AS primary_offset
  FROM entries GROUP BY hash)"""


def override_log(spark, sf_dir):
    """The change log with file entries as they are stored: decimal episode, target ids, scope."""
    ids = F.split("target_ids", ",")
    target = F.struct(*[ids[i].alias(c) for i, c in enumerate(("work_id", "entry_id", "episode_id"))])
    return view(spark, sf_dir, "v_override_log").withColumns({
        "episode": (F.col("episode_thousandths").cast("decimal(13,3)") / 1000).cast("decimal(10,3)"),
        "mode": F.col("file_mode"),
        "target": F.when(F.col("target_ids").isNotNull(), target),
        "scope": F.split("scope_ids", ","),
    })


def override_maps(spark, sf_dir):
    return st.apply_overrides(override_log(spark, sf_dir))


def _flat(maps, *extra):
    season = F.transform(
        F.map_entries("season_map"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]["season"], F.lit("/"), e["value"]["offset"]),
    )
    files = F.transform(
        F.map_entries("file_map"),
        lambda e: F.concat_ws(
            "/", F.concat(e["key"], F.lit("="), e["value"]["season"]), (e["value"]["episode"] * 1000).cast("long"), e["value"]["mode"],
            F.concat_ws(",", e["value"]["target"]["work_id"], e["value"]["target"]["entry_id"], e["value"]["target"]["episode_id"]),
            F.array_join(F.coalesce(e["value"]["scope"], F.array().cast("array<string>")), ","),
        ),
    )
    return maps.select(
        "hash", *extra, F.array_join(F.array_sort(season), ",").alias("season_map"),
        F.array_join(F.array_sort(files), ";").alias("file_map"),
    )


def _osql(body):
    return oracle("+" + MAPS_SQL + " " + body, "v_override_log")


@query("override_apply", _osql("SELECT hash, updated_at, season_map, file_map FROM maps"))
def override_apply(spark, sf_dir):
    return _flat(override_maps(spark, sf_dir), "updated_at")


@query("override_replace", _osql("SELECT hash, season_map FROM maps WHERE hash IN (SELECT hash FROM rep)"))
def override_replace(spark, sf_dir):
    log = view(spark, sf_dir, "v_override_log")
    replaced = log.where("action = 'replace'").select("hash").distinct()
    return _flat(override_maps(spark, sf_dir).join(replaced, "hash", "left_semi")).drop("file_map")


@query("override_get", _osql("""SELECT a.hash, coalesce(season_map, '') AS season_map, coalesce(file_map, '') AS file_map
  FROM (SELECT DISTINCT concat(md5(CAST(c_custkey AS VARCHAR)), substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8)) AS hash FROM customer) a LEFT JOIN maps USING (hash)"""))
def override_get(spark, sf_dir):
    key = F.md5(F.col("c_custkey").cast("string"))
    asked = table(spark, sf_dir, "customer").select(F.upper(F.concat(key, F.substring(key, 1, 8))).alias("hash"))
    return _flat(st.get_overrides(asked, override_maps(spark, sf_dir)))


@query("override_cleanup", _osql("""SELECT hash, season_map, coalesce((SELECT string_agg(map_key || '=' || season || '/' || episode_thousandths || '/' || file_mode || '/' || coalesce(target_ids, '') || '/' || coalesce(scope_ids, ''), ';' ORDER BY map_key)
  FROM entries e WHERE e.hash = maps.hash AND map_kind = 'file' AND has_target = 0), '') AS file_map FROM maps
  WHERE hash IN (SELECT hash FROM entries WHERE map_kind = 'file' AND has_target = 1)"""))
def override_cleanup(spark, sf_dir):
    return _flat(st.drop_targets(override_maps(spark, sf_dir)))


@query("override_summary", oracle("+" + MAPS_SQL + "," + SUMMARY_SQL + " SELECT * FROM summary", "v_override_log"))
def override_summary(spark, sf_dir):
    return st.override_summaries(override_maps(spark, sf_dir))


@query("override_validate", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'file_id' WHEN event_id % 13 = 0 THEN 'mode' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'target'
  WHEN event_id % 3 <> 0 AND (event_id % 7 = 0 OR event_id % 9 - 1 < 0) THEN 'coordinates'
  WHEN event_id % 4 = 1 AND (event_id % 2 = 0 OR event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0) THEN 'scope' END AS error FROM events""")
def override_validate(spark, sf_dir):
    e = F.col("event_id")
    uid = lambda bad: F.when(bad, "00000000-0000-0000-0000-000000000000").otherwise("a1b2c3d4-0000-0000-0000-000000000001")
    file_id = F.when(e % 11 == 0, " ").otherwise(F.concat(F.lit("f"), e))
    scope = F.when(e % 4 == 1, F.when(e % 17 == 0, F.array(F.lit("other"))).when(
        e % 19 == 0, F.array(file_id, file_id)).when(e % 23 == 0, F.array(file_id, F.lit(" "))).otherwise(
        F.array(file_id, F.lit("g"))))
    rows = table(spark, sf_dir, "events").select(
        "event_id", file_id.alias("file_id"),
        F.when(e % 13 == 0, "move").when(e % 2 == 0, "pin").otherwise("anchor").alias("mode"),
        F.when(e % 7 != 0, e % 5).alias("season"), (e % 9 - 1).cast("decimal(10,3)").alias("episode"),
        F.when(e % 3 == 0, F.struct(uid(F.lit(False)).alias("work_id"), uid(e % 5 == 0).alias("entry_id"), uid(F.lit(False)).alias("episode_id"))).alias("target"),
        scope.alias("scope"),
    )
    return rows.select("event_id", va.override_error().alias("error"))


# --- cursors --------------------------------------------------------------------------------

_CURSOR_SQL = """cur AS (SELECT media_type, media_id, CASE WHEN trim(title) = '' THEN 'Untitled' ELSE title END AS title, greatest(0, progress_seconds) AS progress_seconds, ts AS updated_at
  FROM (SELECT *, row_number() OVER (PARTITION BY media_type, media_id ORDER BY ts DESC, event_id DESC) AS n FROM (SELECT CASE lower(media_type) WHEN 'movie' THEN 'movie' ELSE 'tv' END AS media_type,
  media_id, title, progress_seconds, action, ts, event_id FROM v_cursor_log)) WHERE n = 1 AND action <> 'delete')"""


def cursors(spark, sf_dir):
    return st.latest_cursors(view(spark, sf_dir, "v_cursor_log"))


@query("cursor_latest", oracle("+" + _CURSOR_SQL + " SELECT * FROM cur", "v_cursor_log"))
def cursor_latest(spark, sf_dir):
    return cursors(spark, sf_dir)


@query("cursor_ttl", oracle("+" + _CURSOR_SQL + f" SELECT * FROM cur WHERE updated_at >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 3 DAY", "v_cursor_log"))
def cursor_ttl(spark, sf_dir):
    return st.evict_cursors(cursors(spark, sf_dir), AS_OF_EVENTS, days=3)


@query("cursor_recent", oracle("+" + _CURSOR_SQL + f" SELECT * FROM cur WHERE updated_at > TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 90 DAY ORDER BY updated_at DESC, media_type, media_id LIMIT 8", "v_cursor_log"))
def cursor_recent(spark, sf_dir):
    return st.recent_cursors(cursors(spark, sf_dir), AS_OF_EVENTS)


@query("cursor_get", oracle("+" + _CURSOR_SQL + " SELECT media_type, media_id, title, progress_seconds FROM cur WHERE media_type = 'movie' AND media_id = 42", "v_cursor_log"))
def cursor_get(spark, sf_dir):
    found = cursors(spark, sf_dir).where("media_type = 'movie' AND media_id = 42")
    return found.select("media_type", "media_id", "title", "progress_seconds")


# --- queries and subscriptions -----------------------------------------------------------------

_QUERY_SQL = """hits AS (SELECT media_id, min(ts) AS created_at, max(ts) AS last_seen, count(*) AS hits, arg_max(query, {'t': ts, 'e': event_id}) AS query FROM v_query_log WHERE is_refresh = 0 GROUP BY media_id),
  ref AS (SELECT media_id, max(ts) AS last_refresh_attempt_at, max(ts) FILTER (WHERE refresh_ok = 1) AS last_refresh_time,
    (arg_max({'v': CASE WHEN refresh_ok = 1 THEN NULL ELSE 'src_a:timeout' END}, {'t': ts, 'e': event_id})).v AS last_refresh_error FROM v_query_log WHERE is_refresh = 1 GROUP BY media_id),
  q AS (SELECT * FROM hits LEFT JOIN ref USING (media_id))"""
_SUB_SQL = """subs AS (SELECT uid, media_id, media, ts AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY uid, media_id, media ORDER BY ts DESC, event_id DESC) AS n FROM v_subscription_log)
  WHERE n = 1 AND action = 'subscribe')"""


def _attempts(spark, sf_dir):
    log = view(spark, sf_dir, "v_query_log").where("is_refresh = 1")
    ok = F.col("refresh_ok") == 1
    return log.withColumn("ok", ok).withColumn("error", F.when(~ok, "src_a:timeout"))


def query_table(spark, sf_dir):
    searches = view(spark, sf_dir, "v_query_log").where("is_refresh = 0")
    return st.query_table(searches, _attempts(spark, sf_dir))


def subs(spark, sf_dir):
    return st.subscriptions(view(spark, sf_dir, "v_subscription_log"))


@query("query_hits", oracle("+" + _QUERY_SQL + " SELECT * FROM hits", "v_query_log"))
def query_hits(spark, sf_dir):
    return st.query_log(view(spark, sf_dir, "v_query_log").where("is_refresh = 0"))


@query("refresh_state", oracle("+" + _QUERY_SQL + " SELECT * FROM ref", "v_query_log"))
def refresh_state(spark, sf_dir):
    return st.refresh_state(_attempts(spark, sf_dir))


@query("stale_queries", oracle("+" + _QUERY_SQL + f""" SELECT media_id, query FROM q WHERE last_refresh_time IS NULL OR last_refresh_time < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 8000 MINUTE
  ORDER BY last_seen DESC, hits DESC, media_id LIMIT 50""", "v_query_log"))
def stale_queries(spark, sf_dir):
    return st.stale_queries(query_table(spark, sf_dir), AS_OF_EVENTS, older_than_minutes=8000)


@query("subscription_state", oracle("+" + _SUB_SQL + " SELECT * FROM subs", "v_subscription_log"))
def subscription_state(spark, sf_dir):
    return subs(spark, sf_dir)


@query("user_subscriptions", oracle("+" + _SUB_SQL + "," + _QUERY_SQL + " SELECT uid, media_id, media, last_refresh_time FROM subs LEFT JOIN q USING (media_id)", "v_subscription_log", "v_query_log"))
def user_subscriptions(spark, sf_dir):
    return st.user_subscriptions(subs(spark, sf_dir), query_table(spark, sf_dir))


@query("orphan_queries", oracle("+" + _SUB_SQL + "," + _QUERY_SQL + " SELECT media_id, query, hits FROM q WHERE media_id NOT IN (SELECT media_id FROM subs)", "v_subscription_log", "v_query_log"))
def orphan_queries(spark, sf_dir):
    return st.orphan_queries(query_table(spark, sf_dir), subs(spark, sf_dir)).select("media_id", "query", "hits")


@query("subscription_exists", oracle("+" + _SUB_SQL + """ SELECT uid, media_id, media_id IN (SELECT media_id FROM subs s WHERE s.uid = a.uid) AS subscribed
  FROM (SELECT DISTINCT concat('u', CAST(user_id % 40 AS VARCHAR)) AS uid, event_id % 120 AS media_id FROM events) a""", "v_subscription_log"))
def subscription_exists(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 40).alias("uid"), (F.col("event_id") % 120).alias("media_id")
    ).distinct()
    return st.subscription_exists(asked, subs(spark, sf_dir))


_NAMES_SQL = """names AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'kp' WHEN 1 THEN 'imdb' ELSE 'tmdb' END AS kind,
  concat(CASE p_partkey % 3 WHEN 1 THEN 'tt' ELSE '' END, CAST(p_partkey AS VARCHAR(20))) AS id,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('Original ', p_name) END AS original,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name FROM {part})"""
_REQ_SQL = """req AS (SELECT event_id, concat(CASE event_id % 4 WHEN 0 THEN 'kp' WHEN 1 THEN 'tt' WHEN 2 THEN '' ELSE ' !? ' END, CAST(event_id % 2500 AS VARCHAR(20)),
  CASE event_id % 4 WHEN 3 THEN ' text' ELSE '' END) AS query, CASE WHEN event_id % 2 = 0 THEN 'alt-name' END AS alt FROM {events})"""
_RES_SQL = """res AS (SELECT event_id, k AS kind, CASE WHEN k = 'text' THEN query WHEN original IS NOT NULL AND name IS NOT NULL THEN original ELSE coalesce(original, name) END AS search,
  CASE WHEN k <> 'text' AND original IS NOT NULL AND name IS NOT NULL THEN name ELSE alt END AS altname
  FROM (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'kp' WHEN event_id % 4 = 1 THEN 'imdb' WHEN event_id % 4 = 2 THEN 'tmdb' ELSE 'text' END AS k,
    regexp_replace(trim(query), '^kp', '') AS i FROM req) LEFT JOIN names ON names.kind = k AND names.id = i)"""


def _names_requests(spark, sf_dir):
    names = spark.sql("WITH " + _NAMES_SQL + " SELECT * FROM names", part=table(spark, sf_dir, "part"))
    requests = spark.sql("WITH " + _REQ_SQL + " SELECT * FROM req", events=table(spark, sf_dir, "events"))
    return names, requests


_RESOLVE = "WITH " + ", ".join([_NAMES_SQL.format(part="part"), _REQ_SQL.format(events="events"), _RES_SQL])


@query("query_resolve", _RESOLVE + " SELECT * FROM res")
def query_resolve(spark, sf_dir):
    names, requests = _names_requests(spark, sf_dir)
    return st.resolve_queries(requests, names).select("event_id", "kind", "search", "altname")


@query("subscription_accept", _RESOLVE + """ SELECT event_id, tracked FROM (SELECT event_id,
  trim(regexp_replace(regexp_replace(concat_ws(' ', search, altname), '[^a-zA-Zа-яА-ЯёЁ0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS tracked FROM res) WHERE tracked <> ''""")
def subscription_accept(spark, sf_dir):
    names, requests = _names_requests(spark, sf_dir)
    return st.subscribable(requests, names).select("event_id", "tracked")


@query("refresh_rollup", oracle("""+ o AS (SELECT *, strftime(ts, '%Y-%m-%d') AS run, status <> 'disabled' AS en, status IN ('succeeded', 'partial', 'empty') AND write_error_code IS NULL AS ok FROM v_outcomes),
  errs AS (SELECT media_id, run, source || ':' || coalesce(error_code, status) AS e FROM o WHERE en AND NOT ok UNION SELECT media_id, run, source || ':' || write_error_code FROM o WHERE en AND write_error_code IS NOT NULL),
  e AS (SELECT media_id, run, string_agg(e, ',' ORDER BY e) AS errors FROM errs GROUP BY media_id, run)
  SELECT media_id, run, bool_or(en AND ok) AS succeeded, CASE WHEN NOT bool_or(en) THEN 'no_enabled_trackers' WHEN any_value(errors) IS NOT NULL THEN any_value(errors)
    WHEN NOT bool_or(en AND ok) THEN 'no_healthy_trackers' END AS error FROM o LEFT JOIN e USING (media_id, run) GROUP BY media_id, run""", "v_outcomes"))
def refresh_rollup(spark, sf_dir):
    outcomes = view(spark, sf_dir, "v_outcomes").withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    return st.refresh_rollup(outcomes, ["media_id", "run"])


@query("source_health", oracle("""SELECT source, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS attempts, count(*) FILTER (WHERE status = 'failed') AS failures,
  count(*) >= 3 AND count(*) FILTER (WHERE status = 'failed') / count(*) >= 0.25 AS unhealthy,
  CASE WHEN count(*) >= 3 AND count(*) FILTER (WHERE status = 'failed') / count(*) >= 0.25 THEN time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR + INTERVAL 60 SECOND END AS unhealthy_until
  FROM v_outcomes WHERE status <> 'disabled' GROUP BY source, time_bucket(INTERVAL 6 HOUR, ts)""", "v_outcomes"))
def source_health(spark, sf_dir):
    attempts = view(spark, sf_dir, "v_outcomes").where("status <> 'disabled'")
    return st.source_health(attempts, window="6 hours", ratio=0.25)


@query("query_normalize", """SELECT event_id, query AS search_title, CASE WHEN event_id % 3 = 0 THEN 'Orig' WHEN event_id % 3 = 1 THEN 'Eng' ELSE '' END AS search_original,
  CAST(CASE WHEN event_id % 2 = 0 THEN 1990 + event_id % 30 ELSE 0 END AS INT) AS search_year, CAST(CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS INT) AS is_serial
  FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN concat('t', CAST(event_id AS VARCHAR)) ELSE event_type END AS query FROM events)""")
def query_normalize(spark, sf_dir):
    e = F.col("event_id")
    requests = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("query"),
        F.when(e % 5 == 0, F.concat(F.lit("t"), e)).alias("title"),
        F.when(e % 3 == 0, " Orig ").otherwise("  ").alias("original_title"),
        F.when(e % 3 != 2, "Eng").alias("english_title"),
        F.when(e % 2 == 0, (F.lit(1990) + e % 30).cast("string")).otherwise("n/a").alias("year"),
        F.when(F.col("event_type") == "view", "tv").otherwise("movie").alias("media_type"),
    )
    return va.normalize_request(requests).select(
        "event_id", "search_title", "search_original", "search_year", "is_serial"
    )


@query("x_key", "SELECT event_id, 'api:' || event_type || ':' || 'a_' || CAST(user_id AS VARCHAR) || ' b:' AS key FROM events")
def x_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id",
        grouping_key(F.lit(" API "), "event_type", F.concat(F.lit("A:"), "user_id", F.lit("  B ")), F.lit(None).cast("string")).alias("key"),
    )
