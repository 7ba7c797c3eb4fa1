"""Payload envelopes of observations as VARIANT columns.

An envelope has ``schemaVersion``, ``parserVersion``, ``list``, ``details``, ``unmapped`` and ``warnings``. What
is missing, null or not readable gets its default; a payload that is no JSON object is an empty one. The
fragments stay variants, so any path in them can be read without a schema, and ``to_json`` writes
them with their keys in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscat.functions.text import col
from obscat.operators.fold import ARRIVAL, CLOCK, KEY, fold

# The parts of an envelope and the version that it gets by default.
FRAGMENTS = ("list", "details", "unmapped")
SCHEMA_VERSION = 1


def _empty() -> Column:
    return F.parse_json(F.lit("{}"))


def _fragment(payload: Column, name: str) -> Column:
    found = F.try_variant_get(payload, f"$.{name}", "variant")
    return F.when(found.isNotNull() & ~F.is_variant_null(found), found)


def _object(fragment: Column) -> Column:
    """The fragment where it is an object, as a map of variants; an empty map otherwise."""
    is_object = F.schema_of_variant(fragment).startswith("OBJECT")
    entries = F.when(is_object, fragment.cast("map<string, variant>"))
    return F.coalesce(entries, _empty().cast("map<string, variant>"))


def envelope(payload: Column | str) -> Column:
    """Envelope of a JSON text, defaults filled in."""
    node = F.try_parse_json(col(payload))
    version = F.try_variant_get(node, "$.schemaVersion", "int")
    parser = F.try_variant_get(node, "$.parserVersion", "string")
    warnings = F.try_variant_get(node, "$.warnings", "array<string>")
    return F.struct(
        F.coalesce(version, F.lit(SCHEMA_VERSION)).alias("schema_version"), F.coalesce(parser, F.lit("")).alias("parser_version"),
        *[F.coalesce(_fragment(node, f), _empty()).alias(f) for f in FRAGMENTS],
        F.coalesce(warnings, F.array().cast("array<string>")).alias("warnings"),
    )


def merged_fragments(first: Column, second: Column) -> Column:
    """Both fragments as one object; the second wins, and anything but an object counts as empty."""
    a, b = _object(first), _object(second)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_variant_object(F.map_concat(kept, b))


def with_details(lists: Column | str, details: Column | str) -> Column:
    """Envelope of a list row after its details were fetched.

    The list fragment stays, details are those fetched, unmapped parts and warnings are united.
    """
    a, b = col(lists), col(details)
    said = F.filter(a["warnings"], lambda w: F.coalesce(F.trim(w) != "", F.lit(False)))
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), b["parser_version"].alias("parser_version"),
        a["list"].alias("list"), b["details"].alias("details"),
        merged_fragments(a["unmapped"], b["unmapped"]).alias("unmapped"),
        F.array_distinct(F.concat(said, b["warnings"])).alias("warnings"),
    )


def written_envelope(envelope: Column | str) -> dict[str, Column]:
    """Columns of an envelope with the fragments as JSON text."""
    e = col(envelope)
    return {"schema_version": e["schema_version"], "parser_version": e["parser_version"], **{f: F.to_json(e[f]) for f in FRAGMENTS}, "warnings": e["warnings"]}


def fold_payloads(log: DataFrame, payload: str = "payload", keys: Sequence[str] = KEY, arrival: str = ARRIVAL, clock: str = CLOCK) -> DataFrame:
    """Folded rows with the envelope of the last accepted row in ``payload``.

    Its details are those of the last row whose state does not retain what was stored, as in
    :func:`obscat.operators.fold.fold`, which keeps them under ``details``.
    """
    read = envelope(payload)
    rows = log.withColumn("_e", read).withColumn("details", F.to_json("_e.details")).withColumn("_e", F.col("_e").dropFields("details"))
    folded = fold(rows.drop(payload), keys, arrival, clock)
    e = F.col("_e")
    whole = F.struct(
        e["schema_version"].alias("schema_version"), e["parser_version"].alias("parser_version"), e["list"].alias("list"),
        F.parse_json("details").alias("details"), e["unmapped"].alias("unmapped"), e["warnings"].alias("warnings"),
    )
    return folded.withColumn(payload, whole).drop("_e")


def enrich_payloads(lists: DataFrame, details: DataFrame, payload: str = "payload", keys: Sequence[str] = KEY) -> DataFrame:
    """List rows with the envelope of their detail row laid over their own; without one they keep theirs."""
    d = details.select(*keys, F.col(payload).alias("_d"))
    joined = lists.join(d, list(keys), "left")
    both = F.when(F.col("_d").isNotNull(), with_details(payload, "_d")).otherwise(F.col(payload))
    return joined.withColumn(payload, both).drop("_d")
