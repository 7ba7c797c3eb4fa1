"""Masked fold of an observation log into one current row per ``(source, source_key)``.

Rows arrive in ``arrival_key`` order. A row older than the newest row already seen for its
key is late and has no effect at all. Of the other rows each guarded field keeps the newest
value whose bit is set (an observed NULL clears), and unguarded columns follow the last row.

The fold is written as a mergeable state. The state of a stretch of the log holds, per
field, the last value accepted inside the stretch with its ``fetched_at``; two stretches
merge by dropping from the second everything older than the newest row of the first. So a
heavy key can be cut into slices of the log, and a stream can keep one state per micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscat.operators.packing import HASHES, shuffled
from obscat.operators.skew import SLICE, Slices, earlier_slices
from obscat.schema import (
    ALWAYS_OBSERVED,
    FIELD_BITS,
    MASKED_COLUMNS,
    RETAINING_STATES,
    has,
)
from obscat.session import kept

KEY = ("source", "source_key")
CLOCK = "fetched_at"
ARRIVAL = "arrival_key"


def sparse(obs: DataFrame) -> DataFrame:
    """Keep a fact only when its bit is set; link and hash always count as observed."""
    masked = {c: has(f) for f, cols in MASKED_COLUMNS.items() for c in cols}
    out = []
    for name in obs.columns:
        if name == "observed_fields":
            out.append(F.col(name).bitwiseOR(F.lit(ALWAYS_OBSERVED)).alias(name))
        elif name == "size_bytes":
            size = F.when(F.col(name) < 0, 0).otherwise(F.col(name)).cast("long")
            out.append(F.when(masked[name], size).alias(name))
        elif name in masked:
            out.append(F.when(masked[name], F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return obs.select(*out)


def _marked(slices: Slices, columns: Sequence[str], arrival: str, clock: str, pack: str | None = None) -> DataFrame:
    """The log with its slices and ``late``, partitioned by key and slice."""
    keys = slices.keys
    inside = Window.partitionBy(*keys, SLICE).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    # where no key is cut the slice is a constant, by which the window's rows need not be dealt
    met = shuffled(slices.rows, [*keys, SLICE] if slices.cut else keys, pack) if pack else slices.rows
    rows = met.withColumn("_newest", F.max(clock).over(inside))
    if slices.cut:
        newest = slices.heavy().groupBy(*keys, SLICE).agg(F.max(clock).alias("_n"))
        earlier = newest.select(*keys, SLICE, F.max("_n").over(earlier_slices(keys)).alias("_earlier"))
        rows = slices.summed(rows, earlier).withColumn("_newest", F.greatest("_newest", "_earlier"))
    newest = F.col("_newest")
    late = newest.isNotNull() & (F.col(clock).isNull() | F.coalesce(F.col(clock) < newest, F.lit(False)))
    return rows.select(*columns, SLICE, late.alias("late"))


def mark_late(obs: DataFrame, keys: Sequence[str] = KEY, arrival: str = ARRIVAL, clock: str = CLOCK, pack: str | None = None) -> DataFrame:
    """Add ``late``: an earlier arrival of the same key has a newer ``clock``.

    A row without a clock is older than any with one.
    """
    return _marked(Slices(obs, keys, arrival), obs.columns, arrival, clock, pack).drop(SLICE)


def accepted(obs: DataFrame, **kwargs) -> DataFrame:
    """The log without late rows."""
    return mark_late(obs, **kwargs).where(~F.col("late")).drop("late")


def _fields(columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    return {f: cols for f, cols in MASKED_COLUMNS.items() if all(c in columns for c in cols)}


def _followers(columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    taken = {c for cols in MASKED_COLUMNS.values() for c in cols}
    taken |= {*keys, "observed_fields", "details", SLICE, ARRIVAL}
    return [c for c in columns if c not in taken]


def _not_late(obs: DataFrame, group: Sequence[str], arrival: str, clock: str) -> DataFrame:
    """Rows no earlier row of their group is newer than, numbered by arrival in ``_n``."""
    within = Window.partitionBy(*group).orderBy(arrival)
    newest = F.max(clock).over(within.rowsBetween(Window.unboundedPreceding, -1))
    numbered = obs.select("*", newest.alias("_newest"), F.row_number().over(within).alias("_n"))
    return numbered.where(F.col("_newest").isNull() | (F.col(clock) >= F.col("_newest")))


def fold_state(
    obs: DataFrame, keys: Sequence[str] = KEY, arrival: str = ARRIVAL, clock: str = CLOCK,
    carry: Sequence[str] = (), pack: str | None = None,
) -> DataFrame:
    """Mergeable state of the log, one row per ``keys`` (plus ``carry``).

    One shuffle: the running maximum, the row numbers and the aggregation all use the same
    partitioning and the same order. ``pack`` says how rows are packed for it (:mod:`obscat.operators.packing`).
    """
    group = [*carry, *keys]
    rows = _not_late(shuffled(obs, group, pack) if pack else obs, group, arrival, clock)

    def last(columns: Sequence[str], when: Column | None = None) -> Column:
        at = F.col(clock).alias("at")
        order = F.col("_n") if when is None else F.when(when, F.col("_n"))
        return F.max_by(F.struct(at, *columns), order)

    fields = _fields(obs.columns)
    followers = _followers(obs.columns, group)
    known = F.col("observed_fields").bitwiseAND(F.lit(sum(FIELD_BITS.values())).cast("long"))
    states = [
        F.max(clock).alias("newest"),
        # the mask by itself, so that fields nobody reads need not be shuffled for it
        F.coalesce(F.bit_or(known), F.lit(0).cast("long")).alias("seen"),
        # in one struct all of them are shuffled where one is read; each by itself costs more time where all are
        *([last([c]).alias(f"row_{c}") for c in followers] if pack == HASHES else [last(followers).alias("row")]),
        *[last([], has(f)).alias(f"last_{f}") for f in FIELD_BITS if f not in fields],
        *[last(cols, has(f)).alias(f"last_{f}") for f, cols in fields.items()],
    ]
    if "details" in obs.columns:
        kept = ~F.col("details_state").isin(*RETAINING_STATES)
        states += [
            F.min_by(F.struct("details"), F.col("_n")).alias("first_details"),
            last(["details"], kept).alias("last_details"),
        ]
    return rows.groupBy(*group).agg(*states)


def merge_states(states: DataFrame, order: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Merge states of consecutive stretches of the log, ordered by ``order``, per key."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("_bar", F.max("newest").over(before))

    def valid(name: str) -> Column:
        return F.col(name).isNotNull() & (F.col("_bar").isNull() | (F.col(name)["at"] >= F.col("_bar")))

    out = []
    for name in states.columns:
        if name in (*keys, order, "_bar", "seen"):
            continue
        if name == "newest":
            out.append(F.max(name).alias(name))
        elif name == "first_details":
            out.append(F.min_by(name, order).alias(name))
        else:
            out.append(F.max_by(name, F.when(valid(name), F.col(order))).alias(name))
    merged = states.groupBy(*keys).agg(*out)
    seen = F.lit(0).cast("long")
    for field, bit in FIELD_BITS.items():
        seen = seen.bitwiseOR(F.when(F.col(f"last_{field}").isNotNull(), F.lit(bit)).otherwise(F.lit(0)).cast("long"))
    return merged.withColumn("seen", seen)


def finish(states: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Current rows from per-key states."""
    names = states.columns
    rows = {f.name: [c for c in f.dataType.names if c != "at"] for f in states.schema if f.name == "row" or f.name.startswith("row_")}
    out = [*keys, *[F.col(n)[c].alias(c) for n, columns in rows.items() for c in columns]]
    for field, cols in _fields_of(states).items():
        out += [F.col(f"last_{field}")[c].alias(c) for c in cols]
    out.append(F.col("seen").alias("observed_fields"))
    if "last_details" in names:
        kept = F.when(F.col("last_details").isNotNull(), F.col("last_details")["details"])
        first = F.col("first_details")["details"]
        details = F.when(F.col("last_details").isNotNull(), kept).otherwise(first)
        out.append(F.coalesce(details, F.lit("{}")).alias("details"))
    return states.select(*out)


def _fields_of(states: DataFrame) -> dict[str, tuple[str, ...]]:
    """Masked columns that the states carry."""
    held = {f.name: f.dataType.names for f in states.schema.fields if f.name.startswith("last_")}
    return {f: cols for f, cols in MASKED_COLUMNS.items() if set(cols) <= set(held.get(f"last_{f}", ()))}


def fold(
    obs: DataFrame, keys: Sequence[str] = KEY, arrival: str = ARRIVAL, clock: str = CLOCK, pack: str | None = None,
) -> DataFrame:
    """Current row per key; the slices of a heavy key are folded apart and their states merged.

    Bits of the mask beyond the known fields are no observation and are dropped. ``pack`` says how rows are packed for
    the shuffle (:mod:`obscat.operators.packing`).
    """
    slices = Slices(obs, keys, arrival)
    states = fold_state(slices.light().drop(SLICE), keys, arrival, clock, pack=pack)
    if slices.cut:
        heavy = fold_state(slices.heavy(), keys, arrival, clock, carry=(SLICE,), pack=pack)
        states = states.unionByName(merge_states(heavy, SLICE, keys))
    return finish(states, keys)


def relinks(
    obs: DataFrame, keys: Sequence[str] = KEY, arrival: str = ARRIVAL, clock: str = CLOCK
) -> DataFrame:
    """Accepted rows whose item differs from the previous accepted row of the same key."""
    keys = list(keys)
    log = obs.select(*keys, arrival, clock, "entity_hash")
    slices = Slices(log, keys, arrival)
    rows = _marked(slices, log.columns, arrival, clock).where(~F.col("late")).drop("late")
    inside = Window.partitionBy(*keys, SLICE).orderBy(arrival)
    previous = F.lag("entity_hash").over(inside)
    first = F.row_number().over(inside) == 1
    rows = rows.select("*", previous.alias("previous_hash"), first.alias("_first"))
    if slices.cut:
        ends = rows.where(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(F.max_by(F.struct("entity_hash"), arrival).alias("_end"))
        before = F.lag("_end").over(Window.partitionBy(*keys).orderBy(SLICE))
        rows = slices.summed(rows, ends.select(*keys, SLICE, before.alias("_carried")))
        rows = rows.withColumn("previous_hash", F.when(F.col("_first"), F.col("_carried.entity_hash")).otherwise(F.col("previous_hash")))
    return rows.select(*log.columns, "previous_hash").where(F.col("previous_hash") != F.col("entity_hash"))


def media_links(
    obs: DataFrame, query: str = "title", reason: str = "refresh", clock: str = CLOCK
) -> DataFrame:
    """Item to media links: first and last sighting, query text of the latest one."""
    return (
        obs.where(F.col("media_id").isNotNull())
        .groupBy("entity_hash", "media_id")
        .agg(
            F.min(clock).alias("first_seen_at"),
            F.max(clock).alias("last_seen_at"),
            F.max_by(query, F.struct(clock, ARRIVAL)).alias("query"),
        )
        .withColumn("reason", F.lit(reason))
    )


#: Keys with a row of one media id that are broadcast, so that only their rows need be shuffled.
FEW_KEYS = 1_000_000


def keys_of_media(obs: DataFrame, media_id: int, keys: Sequence[str] = KEY) -> DataFrame:
    """All rows of the keys that have a row of a media id, from which its links can be told.

    Keys are told by their hash, as a key too many changes no link. Where more than ``FEW_KEYS`` have such a row,
    the whole log is given back.
    """
    hashed = F.xxhash64(*keys)
    found = kept(obs.where(F.col("media_id") == media_id).select(hashed.alias("_h")).distinct(), "keys")
    if found.limit(FEW_KEYS + 1).count() > FEW_KEYS:
        return obs
    return obs.withColumn("_h", hashed).join(F.broadcast(found), "_h", "left_semi").drop("_h")


def orphan_items(obs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Items ever accepted that no current row points to any more."""
    ever = accepted(obs.select(*KEY, ARRIVAL, CLOCK, "entity_hash")).select("entity_hash").distinct()
    return ever.join(snapshot.select("entity_hash").distinct(), "entity_hash", "left_anti")


def backfill(canonical: DataFrame, existing: DataFrame) -> DataFrame:
    """Seed observations from canonical rows; keys that already exist are left alone."""
    seeds = canonical.select(
        F.lower("source").alias("source"),
        F.col("source_url").alias("source_key"),
        "source_url", "entity_hash", "title", "link", "size_bytes",
        "popularity", "secondary_popularity", "publish_date",
        F.lit(127).cast("long").alias("observed_fields"),
        F.lit("partial").alias("details_state"),
        F.col("updated_at").alias("fetched_at"),
        F.lit(1).alias("payload_schema_version"),
        F.lit("legacy-backfill").alias("parser_version"),
    )
    seeds = first_per_key(seeds, KEY, "entity_hash")
    return seeds.join(existing.select(*KEY).distinct(), list(KEY), "left_anti")


def backfill_links(canonical: DataFrame, existing: DataFrame) -> DataFrame:
    """Seed item to media links from canonical rows with a ``media_id``; links that already exist are left alone."""
    seeds = canonical.where(F.col("media_id").isNotNull()).select(
        "entity_hash", "media_id", F.col("updated_at").alias("first_seen_at"), F.col("updated_at").alias("last_seen_at"),
        F.col("title").alias("query"), F.lit("legacy").alias("reason"),
    )
    keys = ["entity_hash", "media_id"]
    return first_per_key(seeds, keys, "first_seen_at", "query").join(existing.select(*keys).distinct(), keys, "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the first by ``order``; combined before the shuffle."""
    return _one_per_key(df, keys, F.min_by, order)


def last_per_key(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the last by ``order``; combined before the shuffle."""
    return _one_per_key(df, keys, F.max_by, order)


def _one_per_key(df, keys, pick, order) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[c if c in keys else F.col("_r")[c].alias(c) for c in df.columns])
