"""Search over the canonical items: lookup, filters, order, result rows, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscat.functions.text import distinct_ci, parsed_info, search_tokens, size_label
from obscat.operators.merge import merge_duplicates
from obscat.operators.skew import numbered
from obscat.session import kept

DEFAULT_LIMIT = 500
MAX_LIMIT = 2_000
SORTS = {
    "sid": "popularity", "pir": "secondary_popularity", "size": "size_bytes",
    "create": "publish_date",
}
NAME_COLUMNS = ("title", "name", "original_name")
#: Distinct tokens of many queries that are broadcast, and parts in which the hits of one token are cut first.
FEW_TOKENS = 1_000_000
PARTS = 64


def clamp_limit(limit: int = DEFAULT_LIMIT) -> int:
    return max(1, min(MAX_LIMIT, limit))


def top_items(items: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The most popular items, at most the clamped limit."""
    return items.orderBy(F.desc("popularity"), "entity_hash").limit(clamp_limit(limit))


def by_media(items: DataFrame, links: DataFrame, media_id: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Items linked to a media id."""
    linked = links.where(F.col("media_id") == media_id).select("entity_hash")
    return top_items(items.join(linked, "entity_hash", "left_semi"), limit)


def by_title(items: DataFrame, title: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Items with any token of ``title`` in one of their names."""
    tokens = search_tokens(F.lit(title))
    return top_items(items.where(F.coalesce(_any_token(tokens, items.columns), F.lit(False))), limit)


def _any_token(tokens: Column, columns: Sequence[str]) -> Column:
    names = [F.lower(c) for c in NAME_COLUMNS if c in columns]
    return F.exists(tokens, lambda t: F.greatest(*[F.coalesce(n.contains(F.lower(t)), F.lit(False)) for n in names], F.lit(False)))


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; empty when the text is shorter."""
    return F.when(
        F.length(text) >= size,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))),
                lambda i: F.substring(text, i, F.lit(size)),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def many_titles(
    items: DataFrame, queries: DataFrame, item: str = "entity_hash", limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """``(query_id, item, rank)`` for many title queries at once, the most popular hits of each.

    A token can only occur in a name that holds all its three-letter pieces (two-letter for
    two-letter tokens). Each token is looked up by its rarest piece only and the hit is then
    checked, so neither all pairs nor all pieces meet in the join. The best hits of a query are
    among the best of its tokens, so a token's hits are cut before they meet the queries: a common
    token costs a query ``limit`` rows, not all items.
    """
    asked = queries.select(
        "query_id", F.explode(F.transform(search_tokens("query"), lambda t: F.lower(t))).alias("token")
    ).distinct()
    found = token_hits(items, asked.select("token").distinct(), item, limit).join(asked, "token")
    best = Window.partitionBy("query_id").orderBy(F.desc("popularity"), item)
    ranked = (
        found.select("query_id", item, "popularity").distinct()
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= clamp_limit(limit))
    )
    return ranked.select("query_id", item, F.col("rank").cast("long").alias("rank"))


def token_hits(items: DataFrame, tokens: DataFrame, item: str = "entity_hash", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``(token, item, popularity)``: the most popular items with each of some distinct tokens in a name.

    Up to ``FEW_TOKENS`` tokens are broadcast, so that the pieces of all names need not be shuffled.
    """
    names = [c for c in NAME_COLUMNS if c in items.columns]
    few = tokens.limit(FEW_TOKENS + 1).count() <= FEW_TOKENS
    near = F.broadcast if few else lambda df: df
    pieces = tokens.select(
        "token",
        F.explode(
            F.when(F.length("token") >= 3, _grams(F.col("token"), 3)).otherwise(_grams(F.col("token"), 2))
        ).alias("gram"),
    )
    lowered = items.select(item, "popularity", *[F.coalesce(F.lower(c), F.lit("")).alias(c) for c in names])
    grams = F.array_distinct(
        F.concat(*[_grams(F.col(c), size) for c in names for size in (2, 3)])
    )
    wanted = pieces.select("gram").distinct()
    posted = lowered.select(F.explode(grams).alias("gram")).join(near(wanted), "gram", "left_semi")
    frequency = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        pieces.join(frequency, "gram", "left")
        .groupBy("token")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    )
    contains = F.greatest(*[F.col(c).contains(F.col("token")) for c in names], F.lit(False))
    hits = lowered.select("*", F.explode(grams).alias("gram")).join(near(rarest), "gram").where(contains)
    hits = hits.select("token", item, "popularity")
    # dense ranks, as a row that comes twice is one hit; in parts first, so that no task sorts all hits of a token
    order = [F.desc("popularity"), F.col(item)]
    part = F.pmod(F.xxhash64(item), F.lit(PARTS))
    for group in (["token", part], ["token"]):
        hits = hits.withColumn("_n", F.dense_rank().over(Window.partitionBy(*group).orderBy(*order)))
        hits = hits.where(F.col("_n") <= clamp_limit(limit)).drop("_n")
    return hits.distinct()


def apply_filters(
    items: DataFrame, type: str | None = None, source: str | None = None, year: int = 0,
    quality: int = 0, video_type: str | None = None, voice: str | None = None, season: int = 0,
    is_serial: int = 1,
) -> DataFrame:
    """Filters that are set; the year does not apply to serials."""
    if type and type.strip():
        items = items.where(F.array_contains("types", type))
    if source and source.strip():
        items = items.where(F.contains(F.lower("source"), F.lit(source.lower())))
    if year > 0 and is_serial != 2:
        items = items.where(F.col("release_year") == year)
    if quality > 0:
        items = items.where(F.col("quality") == quality)
    if video_type and video_type.strip():
        items = items.where(F.col("video_type") == video_type)
    if voice and voice.strip():
        items = items.where(F.exists("voices", lambda v: F.lower(v) == voice.lower()))
    if season > 0:
        items = items.where(F.array_contains("seasons", season))
    return items


def sort_by(sort: str | None) -> list[Column]:
    """Order of a named sort, newest first for an unknown name."""
    column = SORTS.get((sort or "").lower(), SORTS["create"])
    return [F.desc(column), F.asc("entity_hash")]


def sort_positions(items: DataFrame, modes: Sequence[str]) -> DataFrame:
    """``(mode, entity_hash, position)`` of all items under every named sort, items read once.

    Modes are numbered in slices, so no order of all items has to fit one task. The ordering columns are kept, as
    the slices take several looks at them.
    """
    columns = {m: SORTS.get(m.lower(), SORTS["create"]) for m in modes}
    items = kept(items.select("entity_hash", *dict.fromkeys(columns.values())), "sorts")
    whole = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if c == "publish_date" else F.col(c).cast("long")
    each = F.array(*[F.struct(F.lit(m).alias("mode"), whole(c).alias("by")) for m, c in columns.items()])
    rows = items.select("entity_hash", F.explode(each).alias("x")).select("entity_hash", "x.*")
    order = [F.desc_nulls_last("by"), F.asc("entity_hash")]
    falling = F.coalesce(F.bitwise_not("by"), F.lit((1 << 63) - 1))
    return numbered(rows, ["mode"], order, "position", falling).select("mode", "entity_hash", "position")


def catalog_rows(items: DataFrame) -> DataFrame:
    """Canonical rows as the catalog returns them: defaults, size label, distinct sets."""
    return items.select(
        "entity_hash", "source", "title", "source_url", "size_bytes",
        size_label("size_bytes").alias("size_label"), "link", "popularity",
        "secondary_popularity", "publish_date", "name",
        F.coalesce("release_year", F.lit(0)).alias("release_year"),
        F.coalesce("quality", F.lit(0)).alias("quality"), "video_type", "types",
        distinct_ci("languages").alias("languages"), distinct_ci("voices").alias("voices"),
        F.array_distinct("seasons").alias("seasons"), "updated_at", "parsed_info",
    )


def result_tags(title: str = "title") -> Column:
    """``(kind, value)`` tags from the release attributes of a title."""
    info = parsed_info(title)
    found = (
        ("quality", info["resolution"]), ("source", info["quality"]), ("codec", info["codec"]),
        ("year", F.when(info["year"] > 0, info["year"].cast("string"))), ("voice", info["audio"]),
    )
    tags = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in found])
    return F.filter(tags, lambda t: F.coalesce(t["value"] != "", F.lit(False)))


def result_rows(items: DataFrame) -> DataFrame:
    """Result projection: stable id, plain date text, tags."""
    fallback = F.md5(F.to_json(F.struct("title", "source", "link", "publish_date")))
    return items.select(
        F.coalesce("entity_hash", "source_url", fallback).alias("id"),
        "title",
        F.col("source").alias("source"),
        F.col("size_bytes").cast("long").alias("size_bytes"), size_label("size_bytes").alias("size_label"),
        "popularity", "secondary_popularity",
        F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publish_date"),
        "link", F.col("source_url").alias("url"), result_tags().alias("tags"),
    )


def attach_overrides(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """Override summary of each result whose id is an item hash."""
    # Other ids keep their own text as the key: it matches nothing and does not pile up on NULL.
    is_hash = F.col("id").rlike("^[0-9A-Fa-f]{40}$")
    keyed = results.withColumn("_h", F.when(is_hash, F.lower("id")).otherwise(F.col("id")))
    return keyed.join(summaries.withColumnRenamed("hash", "_h"), "_h", "left").drop("_h")


def event_row(columns: Sequence[str]) -> Column:
    """A result as it is sent, fields without a value left out by JSON; overrides where attached."""
    named = {
        "id": "id", "title": "title", "tracker": "source", "sizeBytes": "size_bytes", "sizeLabel": "size_label",
        "seeders": "popularity", "leechers": "secondary_popularity", "publishDate": "publish_date", "magnetUri": "link",
        "link": "url", "tags": "tags", "viewed": "viewed",
    }
    fields = [F.col(c).alias(n) for n, c in named.items() if c in columns]
    summary = {
        "seasonCount": "season_count", "fileCount": "file_count", "primarySource": "primary_source",
        "primarySeason": "primary_season", "primaryOffset": "primary_offset",
    }
    if "season_count" in columns:
        override = F.struct(*[F.col(c).alias(n) for n, c in summary.items()])
        fields.append(F.when(F.col("season_count").isNotNull(), override).alias("override"))
    return F.struct(*fields)


def search_request(
    items: DataFrame, summaries: DataFrame, title: str, sort: str | None = None, limit: int = DEFAULT_LIMIT,
    title_source: str | None = None, demoted: str | None = None, **filters,
) -> DataFrame:
    """A whole request: most popular hits, merged, then filtered, ordered, shaped, overrides attached.

    Filters come after the limit and the merge, so they see merged rows and never widen the hits.
    ``position`` is the order; there are at most as many rows as the limit allows.
    """
    # at most as many rows as the limit allows, which the merge and the order read several times
    hits = kept(by_title(items, title, limit), "hits").withColumn("source_key", F.coalesce("source_url", "entity_hash"))
    merged = merge_duplicates(hits.drop("entity_hash"), title_source, demoted)
    passed = apply_filters(merged, **filters)
    order = Window.orderBy(*sort_by(sort))
    placed = passed.withColumn("position", F.row_number().over(order).cast("long"))
    shaped = attach_overrides(result_rows(placed), summaries)
    return shaped.join(placed.select(F.col("entity_hash").alias("id"), "position"), "id")


def result_events(results: DataFrame, batch_size: int = 500) -> DataFrame:
    """One JSON line per non-empty batch of results, and a final ``done`` line.

    A source's results are cut into batches of about ``batch_size`` by their hash, so the
    size of a line does not grow with the size of a source. Results are kept, as they are counted first.
    """
    results = kept(results, "results")
    counts = results.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    bucket = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long")
    cut = results.join(F.broadcast(counts), "source").withColumn(  # a row per source
        "batch", bucket % F.ceil(F.col("_rows") / F.lit(batch_size))
    )
    one = event_row(results.columns)
    batches = cut.groupBy("source", "batch").agg(F.array_sort(F.collect_list(one)).alias("results"))
    lines = batches.select(
        "source", "batch", F.size("results").cast("long").alias("n_results"),
        F.to_json(F.struct(F.lit("batch").alias("type"), "source", "results")).alias("line"),
    )
    done = results.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("batch"),
        F.lit(0).cast("long").alias("n_results"), F.lit('{"type":"done"}').alias("line"),
    )
    return lines.unionByName(done)


def write_events(results: DataFrame, path: str, batch_size: int = 500) -> None:
    """Write result events as line-delimited JSON."""
    result_events(results, batch_size).select("line").write.mode("overwrite").text(path)
