"""One canonical row per item, elected field by field from its current observations.

Few items have more observations than a task can hold. Rows of the others are shuffled once, each as
it is, and everything about an item is elected and united where its rows meet. The rows of heavy items,
told by a sketch, are aggregated before the shuffle, so such an item costs one partial row per task,
and their value sets are united value by value, so only distinct values of them meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscat.functions.links import announce_urls, build_link
from obscat.functions.text import stored_info
from obscat.operators.packing import as_bytes, as_text, shuffled
from obscat.operators.skew import heavy_keys, numbered
from obscat.schema import FIELD_BITS, SOURCES, has, source_ordinal, state_rank

ITEM = "entity_hash"
FRESHNESS_MINUTES = 10_080


def rank_key(sources=SOURCES) -> Column:
    """Ordering value of an observation, larger is better.

    Best details state, latest source update (missing last), latest fetch, lowest source
    ordinal; the source key settles the rest.
    """
    return F.struct(
        (-state_rank()).alias("state"),
        F.col("source_updated_at").alias("updated"),
        F.col("fetched_at").alias("fetched"),
        (-source_ordinal(sources=sources)).alias("ordinal"),
        F.col("source_key").alias("key"),
    )


ELECTED = {
    "title": ("title",), "names": ("name", "original_name"), "size": ("size_bytes",),
    "publish_date": ("publish_date",), "release_year": ("release_year",),
    "quality": ("quality",), "video_type": ("video_type",),
}


def elect(field: str, rank: Column) -> Column:
    """Columns of the best row with the bit of ``field``, of the best row at all when none has it."""
    observed = F.coalesce(has(field), F.lit(False))
    return F.max_by(F.struct(*ELECTED[field]), F.struct(observed.alias("o"), rank.alias("r")))


def fresh_max(column: str, field: str, fresh: Column, rank: Column) -> Column:
    """Largest observed value over fresh rows; with none fresh, of the newest row only."""
    observed = F.when(has(field), F.coalesce(F.col(column), F.lit(0)))
    newest = F.max_by(
        F.struct(observed.alias("v")), F.struct(F.col("fetched_at"), rank.alias("r"))
    )["v"]
    among = F.max(F.when(fresh, observed))
    return F.coalesce(F.when(F.max(fresh), among).otherwise(newest), F.lit(0))


SETS = ("types", "languages", "voices", "seasons", "announce")


def golden_record(
    snapshot: DataFrame, as_of: str, freshness_minutes: int = FRESHNESS_MINUTES, sources=SOURCES,
    log: DataFrame | None = None, pack: str | None = None,
) -> DataFrame:
    """Canonical rows of all items with at least one current observation.

    ``log`` names rows that are cheaper to sketch and hold every row of the snapshot's items; without it the
    rows of all items are aggregated before the shuffle. ``pack`` says how rows are packed for it (:mod:`.packing`).
    """
    def combined(rows: DataFrame) -> DataFrame:
        elected = _elections(rows, as_of, freshness_minutes, rank_key(sources))
        return elected.join(_value_sets(rows), ITEM, "left")

    heavy = None if log is None else heavy_keys(log, [ITEM])
    if heavy is None:
        return _canonical(combined(snapshot), as_of)
    if not heavy:
        return _canonical(_together(snapshot, as_of, freshness_minutes, sources, pack), as_of)
    is_heavy = F.xxhash64(ITEM).isin(heavy)
    light = _together(snapshot.where(~is_heavy), as_of, freshness_minutes, sources, pack)
    return _canonical(light.unionByName(combined(snapshot.where(is_heavy))), as_of)


def _together(rows: DataFrame, as_of: str, freshness_minutes: int, sources, pack: str | None) -> DataFrame:
    """Elections and value sets of items whose rows fit a task: one shuffle of the rows, one aggregation.

    Rows are numbered in the order of their rank, so an election holds a number, not the rank.
    """
    best = Window.partitionBy(ITEM).orderBy(F.desc("_rank"))
    announced = rows.withColumn("_announce", announce_urls("link")).drop("link")
    met = shuffled(announced.withColumn(ITEM, as_bytes(F.col(ITEM))) if pack else announced, [ITEM], pack)
    placed = met.withColumn("_rank", rank_key(sources)).withColumn("_place", -F.row_number().over(best))
    united = [F.collect_set(F.when(has(c), F.col(c))).alias(c) for c in SETS[:4]]
    united.append(F.collect_set("_announce").alias("announce"))
    out = _elections(placed, as_of, freshness_minutes, F.col("_place"), *united)
    out = _distinct_values(_distinct_values(out, SETS[:3], F.lower), SETS[3:], lambda v: v)
    return out.withColumn(ITEM, as_text(F.col(ITEM))) if pack else out


def _distinct_values(rows: DataFrame, columns, key) -> DataFrame:
    """Distinct values of arrays of arrays in the order of their keys, of each key the smallest; none: null."""
    sorted_ = rows.withColumns({
        c: F.array_sort(F.transform(
            F.filter(F.array_distinct(F.flatten(c)), lambda v: F.trim(v.cast("string")) != ""),
            lambda v: F.struct(key(v).alias("k"), v.alias("v"))))
        for c in columns
    })
    first = lambda c: F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1)["k"] != x["k"]))
    kept = {c: F.transform(first(F.col(c)), lambda x: x["v"]) for c in columns}
    return sorted_.withColumns({c: F.when(F.size(c) > 0, v) for c, v in kept.items()})


def _value_sets(rows: DataFrame) -> DataFrame:
    """All value sets per item, from one row per distinct value."""

    def tag(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("set"), v.cast("string").alias("v")))

    observed = [F.when(has(c), F.col(c)) for c in SETS[:4]] + [announce_urls("link")]
    tagged = [F.coalesce(tag(n, c), F.array().cast("array<struct<set:string,v:string>>")) for n, c in zip(SETS, observed)]
    values = rows.select(ITEM, F.explode(F.concat(*tagged)).alias("x")).where(F.trim("x.v") != "")
    key = F.when(F.col("x.set").isin("types", "languages", "voices"), F.lower("x.v")).otherwise(F.col("x.v"))
    distinct = values.groupBy(ITEM, F.col("x.set").alias("set"), key.alias("k")).agg(F.min("x.v").alias("v"))

    def collect(name: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("set") == name, F.struct("k", "v"))))
        return F.transform(pairs, lambda x: x["v"])

    sets = {n: collect(n) for n in SETS}
    sets["seasons"] = F.array_sort(F.transform(sets["seasons"], lambda v: v.cast("int")))
    return distinct.groupBy(ITEM).agg(*[c.alias(n) for n, c in sets.items()])


def _elections(rows: DataFrame, as_of: str, freshness_minutes: int, rank: Column, *more: Column) -> DataFrame:
    cutoff = F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL {int(freshness_minutes)} MINUTES")
    fresh = F.col("fetched_at") >= cutoff
    return rows.groupBy(ITEM).agg(
        *[F.max_by(c, rank).alias(f"top_{c}") for c in ("source", "source_url", "fetched_at")],
        *[elect(field, rank).alias(f"best_{field}") for field in ELECTED],
        fresh_max("popularity", "popularity", fresh, rank).alias("popularity"),
        fresh_max("secondary_popularity", "secondary_popularity", fresh, rank).alias(
            "secondary_popularity"
        ),
        *more,
    )


def _canonical(best: DataFrame, as_of: str) -> DataFrame:
    def elected(field: str, column: str) -> Column:
        return F.col(f"best_{field}")[column]

    none = F.array().cast("array<string>")
    return best.select(
        ITEM,
        F.col("top_source").alias("source"),
        F.col("top_source_url").alias("source_url"),
        F.coalesce(elected("title", "title"), F.lit("")).alias("title"),
        elected("names", "name").alias("name"),
        elected("names", "original_name").alias("original_name"),
        F.coalesce(elected("size", "size_bytes"), F.lit(0)).alias("size_bytes"),
        build_link(F.col(ITEM), F.coalesce("announce", none)).alias("link"),
        "popularity",
        "secondary_popularity",
        F.coalesce(elected("publish_date", "publish_date"), "top_fetched_at").alias("publish_date"),
        elected("release_year", "release_year").alias("release_year"),
        elected("quality", "quality").alias("quality"),
        elected("video_type", "video_type").alias("video_type"),
        *[F.coalesce(c, none).alias(c) for c in ("types", "languages", "voices")],
        F.coalesce("seasons", F.array().cast("array<int>")).alias("seasons"),
        F.lit(as_of).cast("timestamp_ntz").alias("updated_at"),
    ).withColumn("parsed_info", stored_info("title"))


def rank_observations(snapshot: DataFrame, sources=SOURCES) -> DataFrame:
    """Every current observation with its position inside its item, 1 best."""
    rows = snapshot.withColumn("_rank", rank_key(sources))
    # a number that never falls along the order: state, then minutes of the update and of the fetch, newest first
    most = (1 << 26) - 1
    minutes = lambda c: F.coalesce(F.least(F.greatest(F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / 60), F.lit(1)), F.lit(most)), F.lit(0))
    along = (state_rank().cast("long") * (1 << 26) + most - minutes("source_updated_at")) * (1 << 26) + most - minutes("fetched_at")
    return numbered(rows, [ITEM], [F.desc("_rank")], "position", along).drop("_rank")


def size_conflicts(snapshot: DataFrame) -> DataFrame:
    """Items whose observed sizes differ by more than one percent of the largest."""
    size = F.when(has("size") & (F.col("size_bytes") > 0), F.col("size_bytes"))
    low, high = F.col("min_size"), F.col("max_size")
    return (
        snapshot.groupBy(ITEM)
        .agg(F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.count(size).alias("n_sizes"))
        .where((F.col("n_sizes") > 1) & ((high - low).cast("double") > high / F.lit(100.0)))
    )


def union_arrays_table(snapshot: DataFrame, column: str, field: str) -> DataFrame:
    """Union of string arrays per item for value sets too large for one buffer."""
    values = snapshot.where(has(field)).select(ITEM, F.explode(column).alias("v"))
    spelled = (
        values.where(F.trim("v") != "").groupBy(ITEM, F.lower("v").alias("k")).agg(F.min("v").alias("v"))
    )
    return spelled.groupBy(ITEM).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias(column)
    )


def field_presence(snapshot: DataFrame) -> DataFrame:
    """How many rows carry each field, one row per field."""
    counts = snapshot.agg(*[F.count_if(has(f)).alias(f) for f in FIELD_BITS])
    return counts.unpivot([], list(FIELD_BITS), "field", "n_rows")
