"""Side tables kept as change logs: override maps, cursors, subscriptions, query log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from obscat.functions.text import clear_query, id_kind

CHANGE = ("ts", "event_id")
CURSOR_DAYS = 90
SEASON_ENTRY = "map<string,struct<season:int,offset:int>>"
TARGET = "struct<work_id:string,entry_id:string,episode_id:string>"
FILE_ENTRY = f"map<string,struct<season:int,episode:decimal(10,3),mode:string,target:{TARGET},scope:array<string>>>"


def _at(columns: Sequence[str] = CHANGE) -> Column:
    return F.struct(*columns)


def cascade_delete(children: DataFrame, deleted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose parent was not deleted."""
    return children.join(deleted.select(*keys).distinct(), list(keys), "left_anti")


# --- override maps --------------------------------------------------------------------------

def apply_overrides(log: DataFrame) -> DataFrame:
    """Current override maps per hash from the change log.

    File changes carry ``season, episode, mode, target`` (three ids) and ``scope`` (file ids).
    The last change of a key decides; a ``replace`` voids all earlier season changes of its
    hash. Changes are reduced to one row per key before anything meets per hash.
    """
    at = _at()
    last = log.groupBy(F.lower("hash").alias("hash"), "map_kind", "map_key").agg(
        F.max_by(F.struct("action", "season", "episode_offset", "episode", "mode", "target", "scope"), at).alias("c"),
        F.max(at).alias("at"),
        F.max(F.when(F.col("action") == "replace", at)).alias("replaced"),
        F.max(F.col("action") != "remove").alias("wrote"),
    )
    season = F.col("map_kind") == "season"
    voided = F.max(F.when(season, F.col("replaced"))).over(Window.partitionBy("hash"))
    alive = (F.col("c.action") != "remove") & (
        ~season | F.col("_voided").isNull() | (F.col("at") >= F.col("_voided"))
    )
    season_entry = F.struct(F.col("c.season").alias("season"), F.col("c.episode_offset").alias("offset"))
    file_entry = F.struct(*[F.col(f"c.{c}").alias(c) for c in ("season", "episode", "mode", "target", "scope")])
    collect = lambda kind, entry: F.map_from_entries(
        F.array_sort(
            F.collect_list(F.when(alive & (F.col("map_kind") == kind), F.struct("map_key", entry.alias("e"))))
        )
    )
    return (
        last.withColumn("_voided", voided)
        .groupBy("hash")
        .agg(
            collect("season", season_entry).cast(SEASON_ENTRY).alias("season_map"),
            collect("file", file_entry).cast(FILE_ENTRY).alias("file_map"),
            F.max("wrote").alias("wrote"),
            F.max("at.ts").alias("updated_at"),
        )
        .where("wrote")
        .drop("wrote")
    )


def get_overrides(hashes: DataFrame, maps: DataFrame) -> DataFrame:
    """Both maps of every asked hash, empty when absent."""
    asked = hashes.select(F.lower("hash").alias("hash")).distinct()
    found = asked.join(maps, "hash", "left")
    empty = lambda kind: F.map_from_arrays(F.array(), F.array()).cast(kind)
    return found.select(
        "hash",
        F.coalesce("season_map", empty(SEASON_ENTRY)).alias("season_map"),
        F.coalesce("file_map", empty(FILE_ENTRY)).alias("file_map"),
    )


def override_summaries(maps: DataFrame) -> DataFrame:
    """Map sizes; source, season and offset only for a single season entry."""
    only = F.when(F.size("season_map") == 1, F.get(F.map_entries("season_map"), F.lit(0)))
    return maps.where((F.size("season_map") > 0) | (F.size("file_map") > 0)).select(
        "hash",
        F.size("season_map").alias("season_count"),
        F.size("file_map").alias("file_count"),
        only["key"].alias("primary_source"),
        only["value"]["season"].alias("primary_season"),
        only["value"]["offset"].alias("primary_offset"),
    )


def drop_targets(maps: DataFrame) -> DataFrame:
    """Remove file entries that carry a target, touching only the rows that have one."""
    targeted = F.exists(F.map_values("file_map"), lambda v: v["target"].isNotNull())
    return maps.where(targeted).withColumn(
        "file_map", F.map_filter("file_map", lambda k, v: v["target"].isNull())
    )


# --- cursors ----------------------------------------------------------------------------------

def latest_cursors(log: DataFrame) -> DataFrame:
    """Current cursor per media type and id; deleted ones are gone."""
    kind = F.when(F.lower("media_type") == "movie", "movie").otherwise("tv")
    rest = [c for c in log.columns if c not in ("media_type", "media_id")]
    last = log.groupBy(kind.alias("media_type"), "media_id").agg(
        F.max_by(F.struct(*rest), _at()).alias("c")
    )
    fixed = {
        "title": F.when(F.coalesce(F.trim("c.title"), F.lit("")) == "", "Untitled").otherwise(F.col("c.title")),
        "progress_seconds": F.greatest(F.lit(0), "c.progress_seconds"),
        "duration_seconds": F.greatest(F.lit(0), "c.duration_seconds") if "duration_seconds" in rest else None,
        "entity_hash": F.lower(F.nullif(F.trim("c.entity_hash"), F.lit(""))) if "entity_hash" in rest else None,
    }
    return last.where(F.col("c.action") != "delete").select(
        "media_type", "media_id",
        *[
            (fixed[c] if fixed.get(c) is not None else F.col(f"c.{c}")).alias("updated_at" if c == "ts" else c)
            for c in rest
            if c not in ("action", "event_id")
        ],
    )


def _since(as_of: str, days: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(days)} DAYS")


def evict_cursors(cursors: DataFrame, as_of: str, days: int = CURSOR_DAYS) -> DataFrame:
    """Cursors not older than the retention time."""
    return cursors.where(F.col("updated_at") >= _since(as_of, days))


def recent_cursors(cursors: DataFrame, as_of: str, limit: int = 8, days: int = CURSOR_DAYS) -> DataFrame:
    """The newest cursors younger than ``days``; the limit is held within 1 to 32."""
    fresh = cursors.where(F.col("updated_at") > _since(as_of, days))
    return fresh.orderBy(F.desc("updated_at"), "media_type", "media_id").limit(max(1, min(32, limit)))


# --- subscriptions and queries ----------------------------------------------------------------

def subscriptions(log: DataFrame) -> DataFrame:
    """Current subscriptions; an ``unsubscribe`` without media ends all of the media id's."""
    at = _at()
    joined = F.col("action") == "subscribe"
    last = log.groupBy("uid", "media_id", "media").agg(
        F.max(F.when(joined, at)).alias("joined"), F.max(F.when(~joined, at)).alias("left")
    )
    everything = F.max(F.when(F.col("media").isNull(), F.col("left"))).over(
        Window.partitionBy("uid", "media_id")
    )
    ended = F.greatest("left", "_all")
    return (
        last.withColumn("_all", everything)
        .where(F.col("media").isNotNull() & F.col("joined").isNotNull())
        .where(ended.isNull() | (F.col("joined") > ended))
        .select("uid", "media_id", "media", F.col("joined.ts").alias("created_at"))
    )


def subscribable(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Requests with the query text they would track, when that is not blank."""
    resolved = resolve_queries(requests, names)
    cleaned = clear_query(F.trim(F.concat_ws(" ", "search", "altname")))
    return resolved.withColumn("tracked", cleaned).where(F.col("tracked") != "")


def resolve_queries(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Names behind id-like queries from a names table ``(kind, id, original, name)``.

    Both names replace the query when both are known, else the known one does.
    """
    kind = id_kind("query")
    number = F.regexp_replace(F.trim("query"), "^kp", "")
    # Plain text keeps itself as the key: it matches no name and does not pile up on NULL.
    keyed = requests.withColumn("_kind", kind).withColumn("_id", number)
    found = keyed.join(
        names.where("kind <> 'text'").select(
            F.col("kind").alias("_kind"), F.col("id").alias("_id"), "original", "name"
        ),
        ["_kind", "_id"], "left",
    )
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    text = F.col("_kind") == "text"
    both = filled("original") & filled("name")
    return found.select(
        *requests.columns, F.col("_kind").alias("kind"),
        F.when(text, F.col("query")).when(both, F.col("original"))
        .otherwise(F.coalesce("original", "name")).alias("search"),
        F.when(~text & both, F.col("name")).otherwise(F.col("alt")).alias("altname"),
    )


def query_log(log: DataFrame) -> DataFrame:
    """Search counts per media id: first and last time, hits, latest text."""
    return log.groupBy("media_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("hits"), F.max_by("query", _at()).alias("query"),
    )


def refresh_state(attempts: DataFrame) -> DataFrame:
    """Last attempt, last success and latest error per media id."""
    return attempts.groupBy("media_id").agg(
        F.max("ts").alias("last_refresh_attempt_at"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_refresh_time"),
        F.max_by(F.struct("error"), _at()).alias("e"),
    ).select("media_id", "last_refresh_attempt_at", "last_refresh_time", F.col("e.error").alias("last_refresh_error"))


def query_table(searches: DataFrame, attempts: DataFrame) -> DataFrame:
    """Query rows with their refresh state; attempts on unknown queries are ignored."""
    return query_log(searches).join(refresh_state(attempts), "media_id", "left")


def stale_queries(queries: DataFrame, as_of: str, older_than_minutes: int = 180, limit: int = 50) -> DataFrame:
    """Queries never refreshed or refreshed too long ago, most recently used first."""
    cutoff = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(older_than_minutes)} MINUTES")
    stale = queries.where(F.col("last_refresh_time").isNull() | (F.col("last_refresh_time") < cutoff))
    ordered = stale.orderBy(F.desc("last_seen"), F.desc("hits"), "media_id").limit(max(0, limit))
    return ordered.select("media_id", "query")


def user_subscriptions(subs: DataFrame, queries: DataFrame, uid: str | None = None) -> DataFrame:
    """Subscriptions with the last refresh of their query, of one user or of all."""
    subs = subs if uid is None else subs.where(F.col("uid") == uid)
    refreshed = queries.select("media_id", "last_refresh_time")
    return subs.join(refreshed, "media_id", "left").select("uid", "media_id", "media", "last_refresh_time")


def subscription_exists(asked: DataFrame, subs: DataFrame, with_media: bool = False) -> DataFrame:
    """Whether each asked user and media id (and media) has a subscription."""
    keys = ["uid", "media_id", "media"] if with_media else ["uid", "media_id"]
    known = subs.select(*keys).distinct().withColumn("_known", F.lit(True))
    found = asked.join(known, keys, "left")
    return found.select(*asked.columns, F.coalesce("_known", F.lit(False)).alias("subscribed"))


def orphan_queries(queries: DataFrame, subs: DataFrame) -> DataFrame:
    """Query rows with no subscription left."""
    return queries.join(subs.select("media_id").distinct(), "media_id", "left_anti")


def refresh_rollup(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Success and error text of each refresh over the outcomes of its sources."""
    enabled = F.col("status") != "disabled"
    healthy = F.col("status").isin("succeeded", "partial", "empty") & F.col("write_error_code").isNull()
    source = F.lower("source")
    run_error = F.when(
        enabled & ~healthy, F.concat_ws(":", source, F.coalesce("error_code", "status"))
    )
    write_error = F.when(
        enabled & F.col("write_error_code").isNotNull(), F.concat_ws(":", source, "write_error_code")
    )
    rolled = outcomes.groupBy(*keys).agg(
        F.max(enabled).alias("any_enabled"),
        F.max(enabled & healthy).alias("succeeded"),
        F.collect_set(run_error).alias("run_errors"),
        F.collect_set(write_error).alias("write_errors"),
    )
    errors = F.array_sort(F.array_union("run_errors", "write_errors"))
    return rolled.select(
        *keys, "succeeded",
        F.when(~F.col("any_enabled"), "no_enabled_trackers")
        .when(F.size(errors) > 0, F.array_join(errors, ","))
        .when(~F.col("succeeded"), "no_healthy_trackers").alias("error"),
    )


def source_health(
    outcomes: DataFrame, window: str = "30 seconds", minimum: int = 3, ratio: float = 0.5,
    hold: str = "60 seconds",
) -> DataFrame:
    """Attempts and failures per source and window; where a source is to be left alone."""
    counts = outcomes.groupBy("source", F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "failed").alias("failures")
    )
    broken = (F.col("attempts") >= minimum) & (F.col("failures") / F.col("attempts") >= ratio)
    return counts.select(
        "source", F.col("w.start").alias("window_start"), "attempts", "failures",
        broken.alias("unhealthy"),
        F.when(broken, F.col("w.end") + F.expr(f"INTERVAL {hold}")).alias("unhealthy_until"),
    )
