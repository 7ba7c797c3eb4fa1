"""Table schemas, observed-field bits and the source dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Position of each field in the "was it observed" mask.
FIELD_BITS = {
    "entity_hash": 1 << 0,
    "link": 1 << 1,
    "title": 1 << 2,
    "size": 1 << 3,
    "popularity": 1 << 4,
    "secondary_popularity": 1 << 5,
    "publish_date": 1 << 6,
    "names": 1 << 7,
    "release_year": 1 << 8,
    "types": 1 << 9,
    "quality": 1 << 10,
    "video_type": 1 << 11,
    "languages": 1 << 12,
    "voices": 1 << 13,
    "seasons": 1 << 14,
    "source_updated_at": 1 << 15,
}

# Detail states from most to least trusted; anything else ranks after them.
DETAIL_STATES = ("fetched", "not_required", "partial", "failed", "budget_exhausted")
RANKED_STATES = ("fetched", "not_required", "partial", "failed")
# States under which the details stored earlier are kept.
RETAINING_STATES = ("failed", "partial", "budget_exhausted")

ALWAYS_OBSERVED = FIELD_BITS["entity_hash"] | FIELD_BITS["link"]

# Columns guarded by one bit of the mask; every other column follows the last accepted row.
MASKED_COLUMNS = {
    "title": ("title",),
    "size": ("size_bytes",),
    "popularity": ("popularity",),
    "secondary_popularity": ("secondary_popularity",),
    "publish_date": ("publish_date",),
    "names": ("name", "original_name"),
    "release_year": ("release_year",),
    "types": ("types",),
    "quality": ("quality",),
    "video_type": ("video_type",),
    "languages": ("languages",),
    "voices": ("voices",),
    "seasons": ("seasons",),
    "source_updated_at": ("source_updated_at",),
}

PAYLOAD = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("parser_version", T.StringType()),
        T.StructField("list", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("unmapped", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_key", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("entity_hash", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("original_name", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("popularity", T.IntegerType()),
        T.StructField("secondary_popularity", T.IntegerType()),
        T.StructField("publish_date", T.TimestampNTZType()),
        T.StructField("release_year", T.IntegerType()),
        T.StructField("quality", T.IntegerType()),
        T.StructField("video_type", T.StringType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("voices", T.ArrayType(T.StringType())),
        T.StructField("seasons", T.ArrayType(T.IntegerType())),
        T.StructField("observed_fields", T.LongType()),
        T.StructField("details_state", T.StringType()),
        T.StructField("source_updated_at", T.TimestampNTZType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
        T.StructField("details", T.StringType()),
        T.StructField("media_id", T.LongType()),
        T.StructField("arrival_key", T.StringType()),
    ]
)

# Default source dimension: name and tie-break ordinal. A deployment passes its own.
SOURCES = tuple((f"src_{c}", i) for i, c in enumerate("abcdefg"))


def source_dimension(spark: SparkSession, sources=SOURCES, disabled=()) -> DataFrame:
    """Source dimension ``(source, ordinal, enabled)``; one row per configured source."""
    rows = [(name, ordinal, name not in disabled) for name, ordinal in sources]
    return spark.createDataFrame(rows, "source string, ordinal int, enabled boolean")


def has(field: str, mask: Column | str = "observed_fields") -> Column:
    """True when the bit of ``field`` is set in ``mask``."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return mask.bitwiseAND(F.lit(FIELD_BITS[field]).cast("long")) != 0


def state_rank(state: Column | str = "details_state") -> Column:
    """Rank of a details state, 0 best."""
    state = F.col(state) if isinstance(state, str) else state
    rank = F.lit(len(RANKED_STATES))
    for position, value in reversed(list(enumerate(RANKED_STATES))):
        rank = F.when(state == value, position).otherwise(rank)
    return rank


def source_ordinal(source: Column | str = "source", sources=SOURCES) -> Column:
    """Tie-break ordinal of a source, unknown sources last."""
    source = F.lower(F.col(source) if isinstance(source, str) else source)
    ordinal = F.lit(2147483647)
    for name, position in reversed(list(sources)):
        ordinal = F.when(source == name, position).otherwise(ordinal)
    return ordinal
