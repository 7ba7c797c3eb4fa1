"""Checks on incoming rows: identity, quarantine, constraints, outcome of a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscat.functions import fixed
from obscat.functions.links import identity_error, link_hash
from obscat.functions.text import first_non_blank
from obscat.schema import DETAIL_STATES, FIELD_BITS


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def error_code(batch_source: Column | str = "batch_source", explicit: str = "explicit_hash") -> Column:
    """First failed check of a row, NULL when it may be stored.

    ``provenance`` names the source in the row's own snapshot; the batch says who sent it.
    """
    batch = F.col(batch_source) if isinstance(batch_source, str) else batch_source
    absolute = F.col("source_url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:.")
    return (
        F.when(F.col("provenance").isNull(), "missing_source")
        .when(F.col("provenance") != batch, "tracker_mismatch")
        .when(_blank("source_key") | ~F.coalesce(absolute, F.lit(False)), "invalid_source")
        .otherwise(identity_error("link", explicit))
    )


def validate(batch: DataFrame, explicit: str = "explicit_hash") -> DataFrame:
    """Add ``error_code`` and the resolved ``entity_hash``; the batch stays whole."""
    return batch.withColumn("error_code", error_code(explicit=explicit)).withColumn(
        "entity_hash", F.when(F.col("error_code").isNull(), link_hash("link"))
    )


def split_quarantine(batch: DataFrame, explicit: str = "explicit_hash") -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantined)`` rows of a validated batch."""
    checked = validate(batch, explicit)
    return (
        checked.where(F.col("error_code").isNull()).drop("error_code"),
        checked.where(F.col("error_code").isNotNull()),
    )


def violations(rows: DataFrame) -> DataFrame:
    """Rows breaking a table constraint, with the constraint's name."""
    broken = F.array_compact(
        F.array(
            F.when(F.col("popularity") < 0, "popularity_nonnegative"),
            F.when(F.col("secondary_popularity") < 0, "secondary_popularity_nonnegative"),
            F.when(~F.col("details_state").isin(*DETAIL_STATES), "details_state"),
        )
    )
    return rows.withColumn("violation", F.explode(broken))


def whole_or_nothing(rows: DataFrame, batch_key: str) -> DataFrame:
    """Rows of the batches without any violation."""
    rejected = violations(rows).select(batch_key).distinct()
    return rows.join(rejected, batch_key, "left_anti")


def without_rejected(results: DataFrame, errors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results whose key is not among the rejected ones."""
    return results.join(errors.select(*keys).distinct(), list(keys), "left_anti")


def observed_mask(**conditions: Column) -> Column:
    """Mask built from which facts were found."""
    mask = F.lit(0).cast("long")
    for field, found in conditions.items():
        bit = F.when(found, FIELD_BITS[field]).otherwise(0).cast("long")
        mask = mask + bit
    return mask


def enabled_sources(items: DataFrame, dimension: DataFrame, column: str = "source") -> DataFrame:
    """Items with at least one enabled source in their comma-joined list."""
    named = items.withColumn("_s", F.transform(F.split(column, ", "), lambda s: F.lower(s)))
    on = dimension.where("enabled").agg(F.collect_set(F.lower("source")).alias("on")).scalar()
    return named.where(F.arrays_overlap("_s", on)).drop("_s")


def allowed_types(items: DataFrame, column: str = "types", allowed=fixed.ALLOWED_TYPES) -> DataFrame:
    """Items with at least one type, all of them allowed."""
    inside = F.forall(column, lambda t: F.lower(t).isin(*allowed))
    return items.where((F.size(column) > 0) & inside)


def page_class(html: str = "html", surface: Column | None = None) -> Column:
    """Class of a fetched page; ``parser_contract`` when the result surface is missing."""
    contains = lambda m: F.lower(html).contains(m.lower())
    any_of = lambda ms: F.greatest(*[contains(m) for m in ms])
    out = (
        F.when(F.col(html).isNull() | (F.trim(F.regexp_replace(html, r"(?U)\s+", " ")) == ""), "invalid_response")
        .when(any_of(fixed.CHALLENGE_MARKERS), "challenge")
        .when(any_of(fixed.AUTHENTICATION_MARKERS), "authentication")
    )
    if surface is not None:
        out = out.when(~surface, "parser_contract")
    return out.otherwise("usable")


def normalize_request(requests: DataFrame) -> DataFrame:
    """Search requests with defaults filled: title, original title, year, serial flag."""
    return requests.select(
        "*",
        F.coalesce("title", "query").alias("search_title"),
        first_non_blank("original_title", "english_title").alias("search_original"),
        F.coalesce(F.trim("year").try_cast("int"), F.lit(0)).alias("search_year"),
        F.when(F.col("media_type") == "tv", 2).otherwise(1).alias("is_serial"),
    )


def override_error() -> Column:
    """Why a file override may not be stored; NULL when it may.

    Columns: file_id, mode, season, episode, target (struct of work, entry, episode ids) and
    scope (array of file ids).
    """
    scope, zero = F.col("scope"), "00000000-0000-0000-0000-000000000000"
    target = F.col("target")
    empty_id = F.greatest(*[
        F.coalesce(target[c] == zero, F.lit(True)) for c in ("work_id", "entry_id", "episode_id")
    ])
    coordinates = F.coalesce((F.col("season") >= 0) & (F.col("episode") >= 0), F.lit(False))
    bad_scope = (
        (F.col("mode") != "anchor")
        | ~F.size(scope).between(1, 2000)
        | F.exists(scope, lambda s: s.isNull() | (F.trim(s) == ""))
        | (F.size(F.array_distinct(scope)) != F.size(scope))
        | ~F.array_contains(scope, F.col("file_id"))
    )
    return (
        F.when(_blank("file_id"), "file_id")
        .when(~F.coalesce(F.col("mode").isin("pin", "anchor"), F.lit(False)), "mode")
        .when(target.isNotNull() & empty_id, "target")
        .when(target.isNull() & ~coordinates, "coordinates")
        .when(scope.isNotNull() & bad_scope, "scope")
    )


def persist_counters(batch: DataFrame) -> DataFrame:
    """What a validated batch wrote: rows, items, item links, errors."""
    ok = F.col("error_code").isNull()
    link = F.when(ok & F.col("media_id").isNotNull(), F.struct("entity_hash", "media_id"))
    return batch.agg(
        F.count_if(ok).alias("observations"),
        F.count_distinct(F.when(ok, F.col("entity_hash"))).alias("items"),
        F.count_distinct(link).alias("links"),
        F.count_if(~ok).alias("errors"),
    )


def surface_rollup(surfaces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failure of a whole search: only when all surfaces failed, a challenge first."""
    failed = F.col("code").isNotNull()
    first = F.min_by("code", F.when(failed, F.col("ord")))
    challenged = F.max(F.coalesce(F.col("code") == "challenge", F.lit(False)))
    return surfaces.groupBy(*keys).agg(
        F.when(F.min(failed), F.when(challenged, "challenge").otherwise(first)).alias("error_code")
    )


def ingest_outcome(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each source run, from its rows.

    Columns: enabled, run_error (timeout or failure of the whole run), error_code (row), ord;
    ``source_key`` is NULL for a run that returned nothing.
    """
    row = F.col("source_key").isNotNull()
    ok = row & F.col("error_code").isNull()
    rejected = row & F.col("error_code").isNotNull()
    first = F.min_by("error_code", F.when(rejected, F.col("ord")))
    counts = batches.groupBy(*keys).agg(
        F.min("enabled").alias("enabled"),
        F.max("run_error").alias("run_error"),
        F.count_if(row).alias("n_rows"),
        F.count_if(ok).alias("n_written"),
        F.count_if(rejected).alias("n_rejected"),
        first.alias("first_error"),
    )
    status = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("run_error") == "timeout", "timedout")
        .when(F.col("run_error").isNotNull(), "failed")
        .when(F.col("n_rows") == 0, "empty")
        .when(F.col("n_rejected") == 0, "succeeded")
        .when(F.col("n_written") > 0, "partial")
        .otherwise("failed")
    )
    error = F.when(F.col("enabled"), F.coalesce("run_error", "first_error"))
    return counts.select(*keys, status.alias("status"), error.alias("error_code"), "n_written")
