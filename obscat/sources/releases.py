"""Nested JSON source: bodies with arrays of releases and of their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscat.functions import fixed
from obscat.functions.links import link_hash, normalize_hash, rebuilt_link
from obscat.functions.text import quality
from obscat.operators.fold import first_per_key
from obscat.operators.validate import observed_mask
from obscat.schema import ALWAYS_OBSERVED

RELEASES = (
    "array<struct<id:int,type:struct<value:string>,year:int,"
    "name:struct<main:string,english:string>,alias:string>>"
)
ITEMS = (
    "array<struct<id:int,hash:string,size:bigint,type:struct<value:string>,"
    "quality:struct<value:string>,magnet:string,seeders:int,leechers:int,"
    "created_at:string,updated_at:string,label:string>>"
)


def releases(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Playable releases of the bodies, each id once."""
    rows = bodies.select(F.posexplode(F.from_json(body, RELEASES)).alias("_at", "r")).select("_at", "r.*")
    kind = F.upper("type.value")
    playable = kind.isNull() | kind.isin(*fixed.PLAYABLE_TYPES)
    kept = rows.where((F.col("id") > 0) & playable)
    return first_per_key(kept, ["id"], "_at", "alias").drop("_at")


def release_items(found: DataFrame, bodies: DataFrame, host: str, body: str = "body") -> DataFrame:
    """Observations of the items of the releases.

    ``bodies`` holds one item array per ``release_id``.
    """
    items = bodies.select(
        "release_id", F.explode(F.from_json(body, ITEMS)).alias("i")
    ).select("release_id", "i.*")
    stated, named = F.col("_h.stated"), F.col("_h.named")
    agree = stated.isNull() | named.isNull() | (stated == named)
    # a filter would read the hashes again for every mention, but none is pushed below an explode of its column
    read = F.struct(normalize_hash("hash").alias("stated"), link_hash("magnet").alias("named"))
    items = (
        items.where(F.col("id") > 0).withColumn("_h", F.explode(F.array(read)))
        .where(agree)
        .withColumns({"entity_hash": F.coalesce(stated, named), "_stated": stated})
    )
    r = found.select(
        F.col("id").alias("release_id"), F.col("year").alias("release_year"),
        F.col("name.main").alias("name"), F.col("name.english").alias("original_name"), "alias",
    )
    rows = items.where(F.col("entity_hash").isNotNull()).join(r, "release_id")
    named_release = F.trim(F.coalesce("name", F.lit(""))) != ""
    lines = quality("quality.value")
    mask = observed_mask(
        title=F.lit(True), types=F.lit(True), publish_date=F.col("created_at").isNotNull(),
        size=F.col("size").isNotNull(), popularity=F.col("seeders").isNotNull(),
        secondary_popularity=F.col("leechers").isNotNull(), names=named_release,
        release_year=F.col("release_year") > 0, quality=lines > 0,
        video_type=F.trim(F.coalesce("type.value", F.lit(""))) != "",
        source_updated_at=F.col("updated_at").isNotNull(),
    ).bitwiseOR(F.lit(ALWAYS_OBSERVED).cast("long"))
    fallback = F.coalesce("label", F.concat(F.lit("Torrent "), "id"))
    return rows.select(
        F.concat_ws(":", "release_id", "id").alias("source_key"),
        F.concat(
            F.lit(f"{host}/release/"), F.coalesce("alias", F.col("release_id").cast("string")),
            F.lit("#item-"), "id",
        ).alias("source_url"),
        "entity_hash",
        rebuilt_link("entity_hash", "magnet").alias("link"),
        F.when(named_release, F.col("name")).otherwise(fallback).alias("title"),
        "name", "original_name", F.col("size").alias("size_bytes"),
        F.coalesce("seeders", F.lit(0)).alias("popularity"),
        F.coalesce("leechers", F.lit(0)).alias("secondary_popularity"),
        "release_year", lines.alias("quality"), F.col("type.value").alias("video_type"),
        F.array(F.lit("anime")).alias("types"),
        _warnings().alias("warnings"),
        mask.alias("observed_fields"), F.lit("not_required").alias("details_state"),
    )


def _warnings() -> Column:
    invalid = F.col("hash").isNotNull() & F.col("_stated").isNull()
    return F.array_compact(
        F.array(
            F.when(invalid, "explicit_hash_invalid"),
            F.when(F.col("magnet").isNull(), "magnet_missing"),
        )
    )
