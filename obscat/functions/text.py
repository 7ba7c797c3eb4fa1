"""Column functions over text: cleaning, sizes, years, seasons, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscat.functions import fixed


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def match(value: Column | str, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(col(value), pattern, group), F.lit(""))


def blank_to_null(value: Column | str) -> Column:
    return F.when(F.length(normalize_text(value)) > 0, col(value))


def normalize_text(value: Column | str) -> Column:
    """Runs of white space become one space; trimmed; NULL becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(col(value), r"(?U)\s+", " ")), F.lit(""))


def clear_query(value: Column | str) -> Column:
    """Latin, Cyrillic, digits and spaces only."""
    kept = F.regexp_replace(col(value), r"(?U)[^a-zA-Zа-яА-ЯёЁ0-9\s]", " ")
    return normalize_text(kept)


def search_key(value: Column | str) -> Column:
    """Lower case, two letters folded, everything but letters and digits dropped."""
    folded = F.translate(F.lower(col(value)), "ёщ", "еш")
    return F.nullif(F.regexp_replace(folded, "[^a-z0-9а-я]", ""), F.lit(""))


def key_part(value: Column | str) -> Column:
    """Normalised part of a grouping key."""
    return F.lower(F.replace(normalize_text(value), F.lit(":"), F.lit("_")))


def grouping_key(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[key_part(p) for p in parts])


def category_key(categories: Column | str) -> Column:
    """Map of categories as sorted ``k:v`` pairs, ``none`` when empty."""
    m = col(categories)
    pairs = F.transform(
        F.array_sort(F.map_entries(m)),
        lambda e: F.concat(key_part(e["key"]), F.lit(":"), key_part(e["value"])),
    )
    empty = m.isNull() | (F.size(m) == 0)
    return F.when(empty, F.lit("none")).otherwise(F.array_join(pairs, ","))


def first_non_blank(*values: Column | str) -> Column:
    """First value that is not blank, trimmed; empty when all are."""
    return F.coalesce(*[F.trim(blank_to_null(v)) for v in values], F.lit(""))


def size_label(size: Column | str) -> Column:
    """Byte count as text, at most two decimals."""
    value = col(size).cast("double")
    label = None
    for power, unit in enumerate(fixed.SIZE_LABELS):
        scaled = F.call_function(
            "format_number", F.round(value / float(1024**power), 2), F.lit("0.##")
        )
        text = F.concat(scaled, F.lit(f" {unit}"))
        label = text if label is None else F.when(value >= float(1024**power), text).otherwise(label)
    return label


def size_bytes(text: Column | str, rounded: bool = True) -> Column:
    """Bytes of a size text such as ``1,5 ГБ``; NULL when none is found."""
    amount = F.replace(match(text, fixed.SIZE_PATTERN, 1), F.lit(","), F.lit(".")).cast("double")
    unit = F.upper(match(text, fixed.SIZE_PATTERN, 2))
    factor = None
    for name, size in fixed.SIZE_UNITS.items():
        factor = F.when(unit == name, float(size)) if factor is None else factor.when(unit == name, float(size))
    value = amount * factor
    return (F.bround(value, 0) if rounded else value).cast("long")


def exact_bytes(text: Column | str) -> Column:
    """Bytes from a ``(123 Bytes)`` note."""
    return match(text, fixed.EXACT_BYTES_PATTERN).try_cast("bigint")


def quality(text: Column | str) -> Column:
    """Vertical resolution: ``1080p``, else a whole number, else 0."""
    lines = match(text, r"(?i)(\d{3,4})p").try_cast("int")
    return F.coalesce(lines, F.trim(col(text)).try_cast("int"), F.lit(0))


def frame_height(text: Column | str) -> Column:
    """Height from a ``1920x1080`` text, 0 when absent."""
    return F.coalesce(match(text, r"(?iu)\d{3,4}\s*[xх]\s*(\d{3,4})").try_cast("int"), F.lit(0))


def year(text: Column | str) -> Column:
    """First standalone 19xx or 20xx year, 0 when absent."""
    return F.coalesce(match(text, fixed.YEAR_PATTERN, 0).try_cast("int"), F.lit(0))


def parse_int(text: Column | str) -> Column:
    return F.coalesce(F.trim(col(text)).try_cast("int"), F.lit(0))


def first_int(text: Column | str) -> Column:
    return match(text, r"\d+", 0).try_cast("int")


def seasons(title: Column | str, kinds: Sequence[str] = ("s_range",)) -> Column:
    """Sorted season numbers named in a title; implausible ranges are dropped."""
    found = []
    for kind in kinds:
        pattern = F.lit(fixed.SEASON_PATTERNS[kind])
        lows = F.regexp_extract_all(col(title), pattern, F.lit(1))
        highs = F.regexp_extract_all(col(title), pattern, F.lit(2))
        found.append(F.zip_with(lows, highs, _season_range))
    return F.array_sort(F.array_distinct(F.flatten(F.concat(*found))))


def _season_range(low: Column, high: Column) -> Column:
    first = low.cast("int")
    last = F.when(high == "", first).otherwise(high.try_cast("int"))
    plausible = (
        (first > 0) & (first < fixed.MAX_SEASON) & (last >= first)
        & (last - first <= fixed.MAX_SEASON_SPAN)
    )
    return F.when(plausible, F.sequence(first, F.greatest(first, last))).otherwise(
        F.array().cast("array<int>")
    )


def fact_seasons(text: Column | str) -> Column:
    """Season numbers in a fact value: standalone numbers of up to three digits."""
    numbers = F.regexp_extract_all(col(text), F.lit(r"(?<!\d)\d{1,3}(?!\d)"), F.lit(0))
    return F.array_sort(
        F.array_distinct(F.filter(F.transform(numbers, lambda n: n.cast("int")), lambda n: n > 0))
    )


def distinct_ci(values: Column | str) -> Column:
    """Distinct ignoring case, first spelling kept."""
    return F.transform(
        F.array_distinct(F.transform(col(values), lambda v: F.collate(v, "UTF8_LCASE"))),
        lambda v: F.collate(v, "UTF8_BINARY"),
    )


def search_tokens(title: Column | str) -> Column:
    """Tokens of a title query, NULL when none is long enough."""
    words = F.transform(
        F.split(col(title), " "), lambda w: F.regexp_replace(normalize_text(w), "[%_]", "")
    )
    tokens = distinct_ci(F.filter(words, lambda w: F.length(w) >= 2))
    return F.when(F.size(tokens) > 0, tokens)


def cyrillic_query(query: Column | str) -> Column:
    """Only the words with a Cyrillic letter; NULL when none or all of them have one."""
    words = F.filter(
        F.transform(F.split(col(query), " "), lambda w: F.trim(w)),
        lambda w: w.rlike("[а-яА-ЯёЁ]"),
    )
    joined = F.array_join(words, " ")
    return F.when((F.size(words) > 0) & (joined != col(query)), joined)


def id_kind(query: Column | str) -> Column:
    """What an id-like query names: ``kp``, ``imdb``, ``tmdb``; ``text`` otherwise."""
    q = F.trim(col(query))
    return (
        F.when(~q.rlike("^((tt|kp)[0-9]+|[0-9]+)$"), "text")
        .when(q.startswith("kp"), "kp").when(q.startswith("tt"), "imdb").otherwise("tmdb")
    )


def content_types(title: Column | str, season_list: Column | str, kind: Column | str,
                  episodic_kind: Column | str) -> Column:
    """Type of a category with an episodic variant, decided by season and episode marks."""
    episodic = (F.size(col(season_list)) > 0) | col(title).rlike(fixed.EPISODIC_MARKER)
    return F.when(col(episodic_kind).isNotNull() & episodic, F.array(col(episodic_kind))).otherwise(
        F.array(col(kind))
    )


def video_type(title: Column | str, family: str = "full") -> Column:
    return match(title, fixed.VIDEO_TYPE_PATTERNS[family], 0)


def _names_part(title: Column) -> Column:
    head = F.regexp_extract(title, r"^(.*?)" + fixed.YEAR_PATTERN, 1)
    has_year = title.rlike(fixed.YEAR_PATTERN)
    return F.when(has_year, F.trim(F.regexp_replace(F.trim(head), r"\(+$", ""))).otherwise(title)


def _parts(text: Column, separator: str) -> Column:
    return F.filter(
        F.transform(F.split(text, separator), normalize_text), lambda p: F.length(p) > 0
    )


def slash_names(title: Column | str) -> tuple[Column, Column]:
    """``Name / Original (2001)``: first and last part before the year."""
    parts = _parts(_names_part(col(title)), " / ")
    original = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    return F.get(parts, F.lit(0)), original


def cyrillic_names(title: Column | str, separator: str = r"\s+/\s+", cut: bool = False
                   ) -> tuple[Column, Column]:
    """First Cyrillic part is the name (else the first part), first other the original."""
    parts = _parts(_names_part(col(title)), separator)
    if cut:
        cleaned = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[\[\(].*$", "")))
        parts = F.filter(cleaned, lambda p: F.length(p) > 0)
    is_cyrillic = lambda p: p.rlike(r"\p{IsCyrillic}")
    original = F.get(F.filter(parts, lambda p: ~is_cyrillic(p)), F.lit(0))
    name = F.coalesce(F.get(F.filter(parts, is_cyrillic), F.lit(0)), F.get(parts, F.lit(0)))
    return name, original


def pattern_names(title: Column | str, patterns) -> Column:
    """First matching pattern as ``struct(name, original_name, release_year)``."""
    t = col(title)
    chosen = F.struct(
        F.trim(t).alias("name"), F.lit(None).cast("string").alias("original_name"),
        year(t).alias("release_year"),
    )
    for pattern, has_original in reversed(patterns):
        last = 3 if has_original else 2
        name = match(t, pattern, 1)
        original = match(t, pattern, 2) if has_original else F.lit(None).cast("string")
        filled = F.length(F.trim(name)) > 0
        if has_original:
            filled &= F.length(F.trim(original)) > 0
        chosen = F.when(
            t.rlike(pattern) & filled,
            F.struct(
                F.trim(name).alias("name"), F.trim(original).alias("original_name"),
                F.coalesce(match(t, pattern, last).try_cast("int"), F.lit(0)).alias("release_year"),
            ),
        ).otherwise(chosen)
    return chosen


def movie_title(title: Column | str) -> Column:
    """Movie title attributes, stereo marks removed."""
    found = pattern_names(title, fixed.MOVIE_PATTERNS)
    matched = F.lit(False)
    for pattern, _ in fixed.MOVIE_PATTERNS:
        matched |= col(title).rlike(pattern)
    name = F.trim(F.regexp_replace(found["name"], "(?iu)в 3Д", ""))
    original = F.trim(F.regexp_replace(found["original_name"], "(?i)(?: in)? 3D", ""))
    return F.struct(
        F.when(matched, name).otherwise(found["name"]).alias("name"),
        original.alias("original_name"), found["release_year"].alias("release_year"),
    )


def serial_title(title: Column | str) -> Column:
    return pattern_names(title, fixed.SERIAL_PATTERNS)


def generic_title(title: Column | str) -> Column:
    """Leading words only; a season or episode mark in them leaves the name open."""
    t = col(title)
    name = match(t, r"^([^/\(\[]+) ", 1)
    blank = F.length(F.trim(F.coalesce(name, F.lit("")))) == 0
    marked = name.rlike("(?iu)(Сезон|Серии)")
    released = F.coalesce(match(t, r" \[([0-9]{4})(?:,|-) ", 1).try_cast("int"), F.lit(0))
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(blank, F.trim(t)).when(marked, none).otherwise(F.trim(name)).alias("name"),
        none.alias("original_name"),
        F.when(blank, year(t)).when(marked, F.lit(0)).otherwise(released).alias("release_year"),
    )


def fallback_name(title: Column | str) -> Column:
    """Text before the first bracket, slash or bar."""
    return F.nullif(F.trim(F.get(F.split(col(title), r"[\[/(|]"), F.lit(0))), F.lit(""))


#: Video types that titles of a flavour may name; flavours that are not listed may name any.
FAMILIES = {"slash": "short", "cut": "broadcast", "movie": "remux"}


def video_type_of(title: Column | str, flavour: Column | str, families: dict[str, str] | None = None) -> Column:
    """Video type of a title by the family of its flavour."""
    families = FAMILIES if families is None else families
    out = video_type(title)
    for name, family in families.items():
        out = F.when(col(flavour) == name, video_type(title, family)).otherwise(out)
    return out


def title_table(df: DataFrame, title: str = "title", flavour: str = "flavour") -> DataFrame:
    """Title attributes of a whole table; the parser and the video types are chosen per row by ``flavour``."""
    slash, cyr = slash_names(title), cyrillic_names(title)
    club = cyrillic_names(title, r"\s+(?:/|\|)\s+", cut=True)
    simple = {"slash": slash, "cyrillic": cyr, "cut": club}
    structured = {
        "movie": movie_title(title), "serial": serial_title(title), "generic": generic_title(title)
    }
    kind = F.col(flavour)
    parsed = None
    for name, (first, original) in simple.items():
        value = F.struct(
            first.alias("name"), original.alias("original_name"), year(title).alias("release_year")
        )
        parsed = F.when(kind == name, value) if parsed is None else parsed.when(kind == name, value)
    for name, value in structured.items():
        parsed = parsed.when(kind == name, value)
    out = df.withColumn("_t", parsed)
    dropped = (kind == "generic") & F.col(title).rlike("(?iu)(?:Сезон|Серии)")
    return (
        out.where(~F.coalesce(dropped, F.lit(False)))
        .select(
            *df.columns,
            F.coalesce(F.nullif(F.col("_t.name"), F.lit("")), fallback_name(title)).alias("name"),
            F.col("_t.original_name").alias("original_name"),
            F.col("_t.release_year").alias("release_year"),
            video_type_of(title, kind).alias("video_type"),
            quality(title).alias("quality"),
        )
    )


def parsed_info(title: Column | str) -> Column:
    """Release attributes named in a title; one pattern per attribute, NULL when absent."""
    low = lambda p: F.lower(match(title, p, 1))
    return F.struct(
        low(r"(?i)\b(\d{3,4}[pi]|4k)\b").alias("resolution"),
        video_type(title).alias("quality"),
        low(r"(?i)\b(x26[45]|h\.?26[45]|hevc|avc|xvid|divx|av1)\b").alias("codec"),
        low(r"(?i)\b(aac|ac3|eac3|dts(?:-hd)?|flac|mp3|truehd)\b").alias("audio"),
        match(title, r"-([A-Za-z0-9]+)$", 1).alias("group"),
        low(r"(?i)\b(mkv|avi|mp4|ts)\b").alias("container"),
        match(title, r"\b(R[1-6])\b", 1).alias("region"),
        F.nullif(year(title), F.lit(0)).alias("year"),
        match(title, r"(?i)\bS(\d{1,2})(?:E\d{1,3})?\b", 1).cast("int").alias("season"),
        match(title, r"(?i)\b(?:S\d{1,2})?E(\d{1,3})\b", 1).cast("int").alias("episode"),
        col(title).rlike(r"(?i)\bcomplete\b").alias("complete"),
    )


def stored_info(title: Column | str) -> Column:
    """Release attributes as canonical rows keep them: season and episode as lists, NULL when absent."""
    info = parsed_info(title)
    kept = [info[c].alias(c) for c in ("resolution", "quality", "codec", "audio", "group", "container", "region", "year")]
    lists = [F.when(info[c].isNotNull(), F.array(info[c])).alias(f"{c}s") for c in ("season", "episode")]
    return F.when(F.trim(col(title)) != "", F.struct(*kept, *lists, info["complete"].alias("complete")))


def url_key(url: Column | str) -> Column:
    """Source key of a URL: its ``t``/``id`` number, its ``/torrent/n`` path, else the URL."""
    u = col(url)
    path = match(u, r"^(?:https?://[^/]+)?(/torrent/\d+)", 1)
    return F.coalesce(match(u, r"(?i)[?&](?:t|id)=(\d+)(?:&|$)", 1), path, u)


def media_format(text: Column | str) -> Column:
    return F.trim(match(text, fixed.FORMAT_PATTERN))


def page_hash(text: Column | str) -> Column:
    return match(text, fixed.HASH_TEXT_PATTERN)


def piece_size(text: Column | str) -> Column:
    return match(text, fixed.PIECE_SIZE_PATTERN)


def breadcrumbs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), "»"), lambda p: F.trim(p)), lambda p: p != "")


def author(text: Column | str) -> Column:
    return F.nullif(normalize_text(match(text, fixed.AUTHOR_PATTERN)), F.lit(""))


def strip_prefix(text: Column | str, prefix: str = fixed.DOWNLOAD_PREFIX) -> Column:
    t = normalize_text(text)
    cut = F.lower(F.substring(t, 1, len(prefix))) == prefix.lower()
    return F.when(cut, F.trim(F.substring(t, len(prefix) + 1, 2**31 - 1))).otherwise(t)


def _upper_half() -> tuple[str, str]:
    codes = [bytes([b]) for b in range(128, 256)]
    known = [(c.decode("latin-1"), c.decode("cp1251")) for c in codes if c != b"\x98"]
    return "".join(k for k, _ in known), "".join(v for _, v in known)


def legacy_text(data: Column | str) -> Column:
    """Text of windows-1251 bytes: one byte per character, upper half translated."""
    latin, cyrillic = _upper_half()
    return F.translate(F.decode(col(data), "ISO-8859-1"), latin, cyrillic)


def legacy_bytes(text: Column | str) -> Column:
    """windows-1251 bytes of a text."""
    latin, cyrillic = _upper_half()
    return F.encode(F.translate(col(text), cyrillic, latin), "ISO-8859-1")
