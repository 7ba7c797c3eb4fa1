"""Queries over the observation log: fold, consolidation, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from obscat.operators import fold as fo
from obscat.operators import golden as go
from obscat.operators import payload as pay
from obscat.operators import validate as va
from obscat.operators.packing import HASHES, ROWS
from obscat.plans.registry import query
from obscat.schema import FIELD_BITS, MASKED_COLUMNS, OBSERVATION, has
from obscat.sources.views import AS_OF_LINEITEM, observations, oracle, view

# --- oracle building blocks -------------------------------------------------------------

_MASKED_SQL = {
    "title": ("title", "title"), "size": ("size_bytes", "greatest(0, size_bytes)"),
    "popularity": ("popularity", "popularity"),
    "secondary_popularity": ("secondary_popularity", "secondary_popularity"),
    "publish_date": ("publish_date", "publish_date"), "names": ("name", "name"),
    "release_year": ("release_year", "release_year"), "types": ("types_csv", "types_csv"),
    "quality": ("quality", "quality"), "video_type": ("video_type", "video_type"),
    "languages": ("languages_csv", "languages_csv"), "voices": ("voices_csv", "voices_csv"),
    "seasons": ("season", "season"),
}


def _bit(field: str) -> str:
    return f"(observed_fields & {FIELD_BITS[field]}) <> 0"


OBS_SQL = (
    "obs AS (SELECT source, source_key, source_url, entity_hash, fetched_at, arrival_key, "
    "details_state, details, media_id, observed_fields | 3 AS observed_fields, "
    + ", ".join(f"CASE WHEN {_bit(f)} THEN {e} END AS {c}" for f, (c, e) in _MASKED_SQL.items())
    + " FROM v_obs)"
)
ACC_SQL = """acc AS (SELECT *, row_number() OVER (PARTITION BY source, source_key ORDER BY arrival_key) AS rn
  FROM (SELECT *, max(fetched_at) OVER (PARTITION BY source, source_key ORDER BY arrival_key
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM obs)
  WHERE prev IS NULL OR fetched_at >= prev)"""


def _last(column: str, cond: str | None = None) -> str:
    where = f" FILTER (WHERE {cond})" if cond else ""
    return f"(arg_max({{'v': {column}}}, rn){where}).v AS {column}"


SNAP_SQL = (
    "snap AS (SELECT source, source_key, "
    + ", ".join(_last(c) for c in ("entity_hash", "source_url", "details_state", "fetched_at", "media_id"))
    + ", " + ", ".join(_last(c, _bit(f)) for f, (c, _) in _MASKED_SQL.items())
    + ", CAST(bit_or(observed_fields) AS BIGINT) AS observed_fields, "
    + _last("details", "rn = 1 OR details_state IN ('fetched', 'not_required')")
    + " FROM acc GROUP BY source, source_key)"
)
RANK_ORDER = """CASE details_state WHEN 'fetched' THEN 0 WHEN 'not_required' THEN 1 WHEN 'partial' THEN 2
    WHEN 'failed' THEN 3 ELSE 4 END, fetched_at DESC,
    CASE source WHEN 'src_a' THEN 0 WHEN 'src_b' THEN 1 WHEN 'src_c' THEN 2 WHEN 'src_d' THEN 3
    WHEN 'src_e' THEN 4 WHEN 'src_f' THEN 5 WHEN 'src_g' THEN 6 ELSE 2147483647 END, source_key DESC"""
RANKED_SQL = (
    f"ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_hash ORDER BY {RANK_ORDER}) AS pos FROM snap)"
)


def sql(body: str, *steps: str) -> str:
    return oracle("+" + ", ".join([OBS_SQL, *steps]) + " " + body, "v_obs")


def snap_sql(body: str, *steps: str) -> str:
    return sql(body, ACC_SQL, SNAP_SQL, *steps)


def obs(spark, sf_dir):
    return observations(view(spark, sf_dir, "v_obs"))


def snapshot(spark, sf_dir):
    return fo.fold(obs(spark, sf_dir))


# --- scan, projection, mask -------------------------------------------------------------

@query("obs_scan", oracle("SELECT source, source_key, entity_hash, fetched_at, details_state FROM v_obs", "v_obs"))
def obs_scan(spark, sf_dir):
    rows = view(spark, sf_dir, "v_obs")
    return rows.select("source", "source_key", "entity_hash", "fetched_at", "details_state")


@query("sparse_projection", sql(
    "SELECT source, source_key, arrival_key, observed_fields, size_bytes, popularity, title, name, release_year, quality FROM obs"))
def sparse_projection(spark, sf_dir):
    return obs(spark, sf_dir).select(
        "source", "source_key", "arrival_key", "observed_fields", "size_bytes", "popularity",
        "title", "name", "release_year", "quality",
    )


@query("has_field_counts", sql(
    " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {_bit(f)}) AS n_rows FROM obs" for f in FIELD_BITS)))
def has_field_counts(spark, sf_dir):
    return go.field_presence(obs(spark, sf_dir))


_FOUND = {
    "title": "title IS NOT NULL", "size": "size_bytes > 0", "names": "name IS NOT NULL",
    "release_year": "release_year > 0", "quality": "quality > 1000",
    "video_type": "video_type IS NOT NULL", "publish_date": "publish_date IS NOT NULL",
}


@query("mask_build", oracle(
    "SELECT arrival_key, source_key, CAST(" + " + ".join(
        f"CASE WHEN {c} THEN {FIELD_BITS[f]} ELSE 0 END" for f, c in _FOUND.items())
    + " AS BIGINT) AS mask FROM v_obs", "v_obs"))
def mask_build(spark, sf_dir):
    mask = va.observed_mask(**{f: F.expr(c) for f, c in _FOUND.items()})
    return view(spark, sf_dir, "v_obs").select("arrival_key", "source_key", mask.alias("mask"))


# --- fold ---------------------------------------------------------------------------------

@query("late_rejected", sql(
    "SELECT source, source_key, arrival_key, fetched_at, late FROM (SELECT *, coalesce(fetched_at < max(fetched_at) OVER "
    "(PARTITION BY source, source_key ORDER BY arrival_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM obs)"))
def late_rejected(spark, sf_dir):
    return fo.mark_late(obs(spark, sf_dir)).select(
        "source", "source_key", "arrival_key", "fetched_at", "late"
    )


FOLD_OUT = (
    "source, source_key, entity_hash, source_url, details_state, fetched_at, media_id, title, name, "
    "size_bytes, popularity, secondary_popularity, publish_date, release_year, quality, video_type, "
    "observed_fields, details"
)
FOLD_SQL = snap_sql(
    f"SELECT {FOLD_OUT}, nullif(types_csv, '') AS types, nullif(languages_csv, '') AS languages, "
    "nullif(voices_csv, '') AS voices, season AS seasons FROM snap"
)


def fold_output(folded):
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return folded.select(
        *FOLD_OUT.split(", "),
        joined("types").alias("types"), joined("languages").alias("languages"),
        joined("voices").alias("voices"), F.get("seasons", F.lit(0)).alias("seasons"),
    )


@query("obs_fold", FOLD_SQL)
def obs_fold(spark, sf_dir):
    return fold_output(snapshot(spark, sf_dir))


@query("obs_mask_or", snap_sql("SELECT source, source_key, observed_fields FROM snap"))
def obs_mask_or(spark, sf_dir):
    rows = fo.accepted(obs(spark, sf_dir).select("source", "source_key", "arrival_key", "fetched_at", "observed_fields"))
    return rows.groupBy("source", "source_key").agg(F.bit_or("observed_fields").alias("observed_fields"))


@query("details_retention", snap_sql("SELECT source, source_key, details_state, details FROM snap"))
def details_retention(spark, sf_dir):
    rows = obs(spark, sf_dir).select(
        "source", "source_key", "arrival_key", "fetched_at", "observed_fields", "details_state", "details"
    )
    return fo.fold(rows).select("source", "source_key", "details_state", "details")


@query("relink_report", sql(
    "SELECT source, source_key, arrival_key, entity_hash, previous_hash FROM (SELECT *, lag(entity_hash) OVER "
    "(PARTITION BY source, source_key ORDER BY arrival_key) AS previous_hash FROM acc) WHERE previous_hash <> entity_hash", ACC_SQL))
def relink_report(spark, sf_dir):
    return fo.relinks(obs(spark, sf_dir)).select(
        "source", "source_key", "arrival_key", "entity_hash", "previous_hash"
    )


@query("media_links", sql(
    "SELECT entity_hash, media_id, min(fetched_at) AS first_seen_at, max(fetched_at) AS last_seen_at, "
    "arg_max(source_url, {'t': fetched_at, 'a': arrival_key}) AS query, 'refresh' AS reason FROM acc GROUP BY ALL", ACC_SQL))
def media_links(spark, sf_dir):
    return fo.media_links(fo.accepted(obs(spark, sf_dir)), query="source_url")


_MOVING_SQL = """moving AS (SELECT source, source_key, fetched_at, arrival_key, rn, concat(source_key, '-', substr(entity_hash, 1, 4)) AS entity_hash FROM acc),
  now_ AS (SELECT source, source_key, arg_max(entity_hash, rn) AS entity_hash FROM moving GROUP BY source, source_key)"""


@query("orphan_items", sql(
    "SELECT DISTINCT entity_hash FROM moving WHERE entity_hash NOT IN (SELECT entity_hash FROM now_)", ACC_SQL, _MOVING_SQL))
def orphan_items(spark, sf_dir):
    log = obs(spark, sf_dir).select(
        "source", "source_key", "arrival_key", "fetched_at", "observed_fields",
        F.concat_ws("-", "source_key", F.substring("entity_hash", 1, 4)).alias("entity_hash"),
    )
    return fo.orphan_items(log, fo.fold(log))


# --- consolidation ------------------------------------------------------------------------

@query("rank_observations", snap_sql(
    "SELECT source, source_key, entity_hash, CAST(pos AS BIGINT) AS position FROM ranked", RANKED_SQL))
def rank_observations(spark, sf_dir):
    log = obs(spark, sf_dir)
    return go.rank_observations(fo.fold(log)).select(
        "source", "source_key", "entity_hash", "position"
    )


def _elect(field: str, column: str) -> str:
    return (
        f"CASE WHEN count(*) FILTER (WHERE {_bit(field)}) > 0 THEN (arg_min({{'v': {column}}}, pos) "
        f"FILTER (WHERE {_bit(field)})).v ELSE (arg_min({{'v': {column}}}, pos)).v END"
    )


def _fresh(column: str, field: str) -> str:
    observed = f"(CASE WHEN {_bit(field)} THEN coalesce({column}, 0) END)"
    return (
        f"coalesce(CASE WHEN bool_or(fresh) THEN max({observed}) FILTER (WHERE fresh) "
        f"ELSE max({observed}) FILTER (WHERE newest = 1) END, 0)"
    )


def _union_sql(column: str, field: str, out: str) -> str:
    return (
        f"u_{out} AS (SELECT entity_hash, string_agg(v, ',' ORDER BY k) AS {out} FROM (SELECT entity_hash, lower(v) AS k, min(v) AS v "
        f"FROM (SELECT entity_hash, unnest(string_split({column}, ',')) AS v FROM snap WHERE {_bit(field)}) "
        f"WHERE trim(v) <> '' GROUP BY entity_hash, lower(v)) GROUP BY entity_hash)"
    )


GOLD_STEPS = (
    RANKED_SQL,
    f"""windowed AS (SELECT *, fetched_at >= TIMESTAMP '{AS_OF_LINEITEM}' - INTERVAL 4000 DAY AS fresh,
      row_number() OVER (PARTITION BY entity_hash ORDER BY fetched_at DESC, pos) AS newest FROM ranked)""",
    "core AS (SELECT entity_hash, arg_min(source, pos) AS source, arg_min(source_url, pos) AS source_url, "
    f"coalesce({_elect('title', 'title')}, '') AS title, {_elect('names', 'name')} AS name, "
    f"coalesce({_elect('size', 'size_bytes')}, 0) AS size_bytes, "
    f"{_fresh('popularity', 'popularity')} AS popularity, "
    f"{_fresh('secondary_popularity', 'secondary_popularity')} AS secondary_popularity, "
    f"coalesce({_elect('publish_date', 'publish_date')}, arg_min(fetched_at, pos)) AS publish_date, "
    f"{_elect('release_year', 'release_year')} AS release_year, {_elect('quality', 'quality')} AS quality, "
    f"{_elect('video_type', 'video_type')} AS video_type, "
    f"string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) FILTER (WHERE {_bit('seasons')}) AS seasons, "
    "'magnet:?xt=urn:btih:' || entity_hash AS link FROM windowed GROUP BY entity_hash)",
    _union_sql("types_csv", "types", "types"), _union_sql("languages_csv", "languages", "languages"),
    _union_sql("voices_csv", "voices", "voices"),
    "golden AS (SELECT core.*, types, languages, voices FROM core LEFT JOIN u_types USING (entity_hash) "
    "LEFT JOIN u_languages USING (entity_hash) LEFT JOIN u_voices USING (entity_hash))",
)
GOLD_MINUTES = 4000 * 24 * 60
GOLD_OUT = (
    "entity_hash, source, source_url, title, name, size_bytes, popularity, secondary_popularity, "
    "publish_date, release_year, quality, video_type, link"
)


def gold_sql(body: str, *steps: str) -> str:
    return snap_sql(body, *GOLD_STEPS, *steps)


def golden(spark, sf_dir, pack=None):
    """``pack``: whole rows where the query reads most canonical columns, else hashes."""
    log = obs(spark, sf_dir)
    # no canonical column comes from the details or the media id: they need not be shuffled
    return golden_of(fo.fold(log.drop("details", "media_id"), pack=pack), log, pack)


def golden_of(snap, log, pack=None):
    return go.golden_record(snap, AS_OF_LINEITEM, GOLD_MINUTES, log=log, pack=pack)


def flat_golden(gold):
    joined = lambda c: F.nullif(F.array_join(c, ","), F.lit(""))
    return gold.select(
        *GOLD_OUT.split(", "),
        *[joined(c).alias(c) for c in ("types", "languages", "voices")],
        joined(F.transform("seasons", lambda s: s.cast("string"))).alias("seasons"),
    )


@query("golden_record", gold_sql(f"SELECT {GOLD_OUT}, types, languages, voices, seasons FROM golden"))
def golden_record(spark, sf_dir):
    return flat_golden(golden(spark, sf_dir, ROWS))


@query("fresh_max", gold_sql("SELECT entity_hash, popularity, secondary_popularity FROM core"))
def fresh_max(spark, sf_dir):
    return golden(spark, sf_dir).select("entity_hash", "popularity", "secondary_popularity")


@query("union_arrays_ci", snap_sql(
    "SELECT entity_hash, languages FROM u_languages", _union_sql("languages_csv", "languages", "languages")))
def union_arrays_ci(spark, sf_dir):
    out = go.union_arrays_table(snapshot(spark, sf_dir), "languages", "languages")
    return out.select("entity_hash", F.array_join("languages", ",").alias("languages"))


@query("union_int_arrays", snap_sql(
    f"SELECT entity_hash, string_agg(DISTINCT CAST(season AS VARCHAR), ',' ORDER BY CAST(season AS VARCHAR)) AS seasons "
    f"FROM snap WHERE {_bit('seasons')} GROUP BY entity_hash"))
def union_int_arrays(spark, sf_dir):
    rows = snapshot(spark, sf_dir).where(has("seasons")).select("entity_hash", F.explode("seasons").alias("s"))
    merged = rows.groupBy("entity_hash").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return merged.select("entity_hash", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("seasons"))


@query("size_conflicts", snap_sql(
    "SELECT entity_hash, min(size_bytes) AS min_size, max(size_bytes) AS max_size, count(*) AS n_sizes FROM snap "
    f"WHERE {_bit('size')} AND size_bytes > 0 GROUP BY entity_hash HAVING count(*) > 1 AND max(size_bytes) - min(size_bytes) > max(size_bytes) / 100.0"))
def size_conflicts(spark, sf_dir):
    return go.size_conflicts(snapshot(spark, sf_dir))


@query("backfill_insert_ignore", gold_sql(
    "SELECT source, source_key, entity_hash, observed_fields, details_state, parser_version FROM ("
    "SELECT lower(source) AS source, source_url AS source_key, min(entity_hash) AS entity_hash, CAST(127 AS BIGINT) AS observed_fields, "
    "'partial' AS details_state, 'legacy-backfill' AS parser_version FROM golden GROUP BY lower(source), source_url) g "
    "WHERE NOT EXISTS (SELECT 1 FROM snap s WHERE s.source = g.source AND s.source_url = g.source_key AND s.popularity > 25)"))
def backfill_insert_ignore(spark, sf_dir):
    log = obs(spark, sf_dir)
    snap = fo.fold(log.drop("details", "media_id"), pack=HASHES)
    gold = golden_of(snap, log, HASHES)
    existing = snap.where("popularity > 25").select("source", F.col("source_url").alias("source_key"))
    return fo.backfill(gold, existing).select(
        "source", "source_key", "entity_hash", "observed_fields", "details_state", "parser_version"
    )


@query("backfill_links", gold_sql(
    "SELECT g.entity_hash, m.media_id, updated_at AS first_seen_at, updated_at AS last_seen_at, title AS query, 'legacy' AS reason FROM "
    f"(SELECT *, TIMESTAMP '{AS_OF_LINEITEM}' AS updated_at FROM golden) g JOIN (SELECT entity_hash, max(media_id) AS media_id FROM snap GROUP BY entity_hash) m ON m.entity_hash = g.entity_hash "
    "WHERE m.media_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM acc a WHERE a.entity_hash = g.entity_hash AND a.media_id = m.media_id AND a.popularity > 25)"))
def backfill_links(spark, sf_dir):
    rows = obs(spark, sf_dir)
    snap = fo.fold(rows.drop("details"), pack=HASHES)
    media = snap.groupBy("entity_hash").agg(F.max("media_id").alias("media_id"))
    gold = golden_of(snap, rows, HASHES).join(media.withColumn("media_id", F.when(F.col("media_id") % 5 != 0, F.col("media_id"))), "entity_hash")
    return fo.backfill_links(gold, fo.media_links(fo.accepted(rows, pack=HASHES).where("popularity > 25"), query="source_url"))


# --- validation ----------------------------------------------------------------------------

_BATCH_SQL = """batch AS (SELECT source AS batch_source, arrival_key, media_id,
  CASE WHEN media_id % 19 = 0 THEN NULL WHEN media_id % 23 = 0 THEN 'src_z' ELSE source END AS provenance,
  CASE WHEN media_id % 29 = 0 THEN ' ' ELSE source_key END AS source_key,
  CASE WHEN media_id % 31 = 0 THEN '/relative' ELSE source_url END AS source_url,
  CASE WHEN media_id % 37 = 0 THEN '' WHEN media_id % 41 = 0 THEN 'http://x/?xt=1'
    WHEN media_id % 43 = 0 THEN 'magnet:?xt=urn:btih:zz' ELSE concat('magnet:?xt=urn:btih:', upper(entity_hash)) END AS link,
  CASE WHEN media_id % 47 = 0 THEN 'nope' WHEN media_id % 53 = 0 THEN md5('a') WHEN media_id % 59 = 0 THEN concat(md5('a'), '00000000')
    WHEN media_id % 2 = 0 THEN '' ELSE entity_hash END AS explicit_hash, popularity, secondary_popularity, details_state, fetched_at
  FROM v_obs)"""
_CHECKED_SQL = """checked AS (SELECT *, CASE WHEN provenance IS NULL THEN 'missing_source'
  WHEN provenance <> batch_source THEN 'tracker_mismatch'
  WHEN trim(source_key) = '' OR NOT regexp_matches(source_url, '^[A-Za-z][A-Za-z0-9+.-]*:.') THEN 'invalid_source'
  WHEN link = '' THEN 'missing_magnet'
  WHEN NOT regexp_matches(link, '^magnet:\\?xt=urn:btih:[0-9A-Fa-f]{40}$') THEN 'invalid_magnet'
  WHEN explicit_hash = 'nope' THEN 'invalid_hash'
  WHEN explicit_hash <> '' AND length(explicit_hash) = 32 AND NOT regexp_matches(upper(explicit_hash), '^[A-Z2-7]+$') THEN 'invalid_hash'
  WHEN explicit_hash <> '' AND lower(explicit_hash) <> lower(substr(link, 21)) THEN 'hash_mismatch' END AS error_code,
  lower(substr(link, 21)) AS link_hash FROM batch)"""


def _batch(spark, sf_dir):
    v = view(spark, sf_dir, "v_obs")
    return spark.sql("WITH v_obs AS (SELECT * FROM {v}), " + _BATCH_SQL + " SELECT * FROM batch", v=v)


@query("validate_quarantine", oracle(
    "+" + _BATCH_SQL + "," + _CHECKED_SQL + " SELECT arrival_key, source_key, error_code, CASE WHEN error_code IS NULL THEN link_hash END AS entity_hash FROM checked", "v_obs"))
def validate_quarantine(spark, sf_dir):
    return va.validate(_batch(spark, sf_dir)).select(
        "arrival_key", "source_key", "error_code", "entity_hash"
    )


@query("persist_counters", oracle(
    "+" + _BATCH_SQL + "," + _CHECKED_SQL + " SELECT count(*) FILTER (WHERE error_code IS NULL) AS observations, "
    "count(DISTINCT link_hash) FILTER (WHERE error_code IS NULL) AS items, count(DISTINCT (link_hash, media_id)) FILTER (WHERE error_code IS NULL) AS links, "
    "count(*) FILTER (WHERE error_code IS NOT NULL) AS errors FROM checked", "v_obs"))
def persist_counters(spark, sf_dir):
    return va.persist_counters(va.validate(_batch(spark, sf_dir)))


@query("accepted_minus_rejected", oracle(
    "+" + _BATCH_SQL + "," + _CHECKED_SQL + " SELECT arrival_key, source_key FROM checked WHERE NOT EXISTS (SELECT 1 FROM checked e "
    "WHERE e.error_code IS NOT NULL AND e.batch_source = checked.batch_source AND e.source_key = checked.source_key)", "v_obs"))
def accepted_minus_rejected(spark, sf_dir):
    checked = va.validate(_batch(spark, sf_dir))
    errors = checked.where(F.col("error_code").isNotNull())
    keys = ["batch_source", "source_key"]
    return va.without_rejected(checked, errors, keys).select("arrival_key", "source_key")


@query("ingest_outcome", oracle(
    "+" + _BATCH_SQL + "," + _CHECKED_SQL + """ SELECT batch_source, media_id,
  CASE WHEN media_id % 13 = 0 THEN 'disabled' WHEN media_id % 17 = 0 THEN 'timedout' WHEN count(*) FILTER (WHERE error_code IS NOT NULL) = 0 THEN 'succeeded'
    WHEN count(*) FILTER (WHERE error_code IS NULL) > 0 THEN 'partial' ELSE 'failed' END AS status,
  CASE WHEN media_id % 13 = 0 THEN NULL WHEN media_id % 17 = 0 THEN 'timeout' ELSE arg_min(error_code, arrival_key) END AS error_code,
  count(*) FILTER (WHERE error_code IS NULL) AS n_written FROM checked GROUP BY batch_source, media_id""", "v_obs"))
def ingest_outcome(spark, sf_dir):
    runs = va.validate(_batch(spark, sf_dir)).select(
        "batch_source", "media_id", "source_key", "error_code", F.col("arrival_key").alias("ord"),
        (F.col("media_id") % 13 != 0).alias("enabled"),
        F.when(F.col("media_id") % 17 == 0, "timeout").alias("run_error"),
    )
    return va.ingest_outcome(runs, ["batch_source", "media_id"])


_DQ_SQL = """dq AS (SELECT source_key, arrival_key, media_id, CAST(popularity - 3 AS INT) AS popularity,
  CAST(secondary_popularity - 1 AS INT) AS secondary_popularity,
  CASE WHEN media_id % 10 = 0 THEN 'odd' ELSE details_state END AS details_state FROM v_obs)"""


@query("dq_violations", oracle("+" + _DQ_SQL + """ SELECT arrival_key, source_key, 'popularity_nonnegative' AS violation FROM dq WHERE popularity < 0
  UNION ALL SELECT arrival_key, source_key, 'secondary_popularity_nonnegative' FROM dq WHERE secondary_popularity < 0
  UNION ALL SELECT arrival_key, source_key, 'details_state' FROM dq WHERE details_state = 'odd'""", "v_obs"))
def dq_violations(spark, sf_dir):
    v = view(spark, sf_dir, "v_obs")
    rows = spark.sql("WITH v_obs AS (SELECT * FROM {v}), " + _DQ_SQL + " SELECT * FROM dq", v=v)
    return va.violations(rows).select("arrival_key", "source_key", "violation")


@query("dq_whole_batch", oracle("+" + _DQ_SQL + """ SELECT arrival_key, source_key, media_id FROM dq WHERE media_id NOT IN
  (SELECT media_id FROM dq WHERE popularity < 0 OR secondary_popularity < 0 OR details_state = 'odd')""", "v_obs"))
def dq_whole_batch(spark, sf_dir):
    v = view(spark, sf_dir, "v_obs")
    rows = spark.sql("WITH v_obs AS (SELECT * FROM {v}), " + _DQ_SQL + " SELECT * FROM dq", v=v)
    return va.whole_or_nothing(rows, "media_id").select("arrival_key", "source_key", "media_id")


@query("surface_rollup", oracle("""SELECT media_id, run_id % 50 AS run, CASE WHEN count(*) FILTER (WHERE error_code IS NULL) > 0 THEN NULL
  ELSE arg_min(error_code, run_id) END AS error_code FROM v_outcomes GROUP BY media_id, run_id % 50""", "v_outcomes"))
def surface_rollup(spark, sf_dir):
    runs = view(spark, sf_dir, "v_outcomes").select(
        "media_id", (F.col("run_id") % 50).alias("run"), F.col("error_code").alias("code"), F.col("run_id").alias("ord")
    )
    return va.surface_rollup(runs, ["media_id", "run"])


@query("cascade_delete", gold_sql(
    "SELECT source, source_key, entity_hash FROM snap WHERE entity_hash NOT IN (SELECT entity_hash FROM golden WHERE popularity >= 45)"))
def cascade_delete(spark, sf_dir):
    from obscat.operators.state import cascade_delete as cascade

    log = obs(spark, sf_dir)
    snap = fo.fold(log.drop("details", "media_id"), pack=HASHES)
    gold = golden_of(snap, log, HASHES)
    deleted = gold.where("popularity >= 45")
    return cascade(snap, deleted, ["entity_hash"]).select("source", "source_key", "entity_hash")


# --- payload envelopes --------------------------------------------------------------------

def _part(name: str, default: str) -> str:
    return f"CASE WHEN json_type(node, '$.{name}') <> 'NULL' THEN CAST(json_extract(node, '$.{name}') AS VARCHAR) ELSE '{default}' END"


ENVELOPE_SQL = f"""env AS (SELECT * EXCLUDE (node, payload), coalesce(CAST(json_extract_string(node, '$.schemaVersion') AS INT), 1) AS schema_version,
  coalesce(json_extract_string(node, '$.parserVersion'), '') AS parser_version, {_part("list", "{}")} AS list, {_part("details", "{}")} AS details,
  {_part("unmapped", "{}")} AS unmapped, coalesce(CAST(json_extract(node, '$.warnings') AS VARCHAR[]), CAST([] AS VARCHAR[])) AS warnings
  FROM (SELECT *, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN CAST(payload AS JSON) END AS node FROM v_payloads))"""
_ENVELOPE_OUT = "schema_version, parser_version, list, details, unmapped, array_to_string(warnings, ',') AS warnings"


def _written(rows):
    parts = pay.written_envelope("payload")
    return rows.select(
        "source", "source_key", "details_state", *[(F.array_join(c, ",") if name == "warnings" else c).alias(name) for name, c in parts.items()])


@query("payload_retention", oracle(f"""+ {ENVELOPE_SQL}, {ACC_SQL.replace("FROM obs)", "FROM env)")},
  snap AS (SELECT source, source_key, {", ".join(_last(c) for c in ("details_state", "schema_version", "parser_version", "list", "unmapped", "warnings"))},
    {_last("details", "rn = 1 OR details_state IN ('fetched', 'not_required')")} FROM acc GROUP BY source, source_key)
  SELECT source, source_key, details_state, {_ENVELOPE_OUT} FROM snap""", "v_payloads"))
def payload_retention(spark, sf_dir):
    return _written(pay.fold_payloads(view(spark, sf_dir, "v_payloads")))


@query("payload_details", oracle(f"""+ {ENVELOPE_SQL},
  l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_key ORDER BY arrival_key DESC) AS n FROM env WHERE details_state <> 'fetched') WHERE n = 1),
  d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, source_key ORDER BY arrival_key DESC) AS n FROM env WHERE details_state = 'fetched') WHERE n = 1)
  SELECT l.source, l.source_key, l.details_state, CASE WHEN d.n IS NULL THEN l.schema_version ELSE 1 END AS schema_version,
    coalesce(d.parser_version, l.parser_version) AS parser_version, l.list, coalesce(d.details, l.details) AS details,
    CASE WHEN d.n IS NULL THEN l.unmapped ELSE CAST(json_merge_patch(CAST(l.unmapped AS JSON), CAST(d.unmapped AS JSON)) AS VARCHAR) END AS unmapped,
    array_to_string(CASE WHEN d.n IS NULL THEN l.warnings ELSE list_filter(list_concat(list_filter(l.warnings, lambda w: trim(w) <> ''), d.warnings),
      lambda w, i: list_position(list_concat(list_filter(l.warnings, lambda w: trim(w) <> ''), d.warnings), w) = i) END, ',') AS warnings
  FROM l LEFT JOIN d USING (source, source_key)""", "v_payloads"))
def payload_details(spark, sf_dir):
    rows = view(spark, sf_dir, "v_payloads").select("source", "source_key", "arrival_key", "details_state", "payload")
    last = lambda r: fo.last_per_key(r, list(fo.KEY), "arrival_key").withColumn("payload", pay.envelope("payload"))
    lists, details = last(rows.where("details_state <> 'fetched'")), last(rows.where("details_state = 'fetched'"))
    return _written(pay.enrich_payloads(lists, details))
