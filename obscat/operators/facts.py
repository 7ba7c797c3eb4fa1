"""Labelled facts of pages: merging, numbering, lookup, scrubbing; list and detail rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obscat.functions import fixed
from obscat.functions.text import col, distinct_ci, match, normalize_text
from obscat.operators.skew import numbered
from obscat.schema import MASKED_COLUMNS, has

PAGE = "page_id"
ORDER = ("seq", "tie_key")


def clean_facts(facts: DataFrame) -> DataFrame:
    """Labels and values trimmed; unusable rows dropped."""
    label = F.trim(F.regexp_replace(normalize_text("label"), ":+$", ""))
    value = F.regexp_replace(normalize_text("value"), r"^[:\s ]+", "")
    return (
        facts.withColumn("label", label).withColumn("value", value)
        .where(F.length("label").between(1, fixed.MAX_LABEL) & (F.length("value") > 0))
    )


def merge_facts(facts: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per page and label: values in order joined by a bar unless already contained.

    A value that repeats is contained by then, so only first sightings are collected.
    """
    at = F.struct(*order)
    seen = clean_facts(facts).groupBy(PAGE, F.lower("label").alias("_k"), "value").agg(
        F.min(at).alias("at"), F.min_by("label", at).alias("label")
    )
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    joined = F.aggregate(
        values, F.lit(""),
        lambda acc, v: F.when(acc == "", v).when(acc.contains(v), acc).otherwise(
            F.concat(acc, F.lit(" | "), v)
        ),
    )
    return seen.groupBy(PAGE, "_k").agg(
        F.min_by("label", "at").alias("label"), joined.alias("value")
    ).select(PAGE, "label", "value")


def suffix_facts(facts: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Repeated labels numbered: ``Audio``, ``Audio 2``, and so on.

    A number that a label of the same page carries itself is passed over, so keys are unique.
    """
    keyed = clean_facts(facts).withColumn("_k", F.lower("label"))
    counted = numbered(keyed, [PAGE, "_k"], [F.col(c) for c in order], "_n", order[0], (facts, [PAGE]))
    spelled = F.regexp_extract("_k", r"^(.+) ([2-9]|[1-9][0-9]+)$", 2)
    # only a label with a digit can carry a number
    taken = (
        clean_facts(facts.where(F.col("label").rlike("[0-9]"))).withColumn("_k", F.lower("label")).select(PAGE, F.regexp_extract("_k", r"^(.+) ([2-9]|[1-9][0-9]+)$", 1).alias("_k"), spelled.try_cast("long").alias("_t"))
        .where(F.col("_t").isNotNull()).groupBy(PAGE, "_k").agg(F.array_sort(F.collect_set("_t")).alias("_taken"))
    )
    none = F.array().cast("array<bigint>")
    free = F.aggregate(F.coalesce("_taken", none), F.col("_n"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    key = F.when(F.col("_n") > 1, F.concat_ws(" ", "label", free)).otherwise(F.col("label"))
    return counted.join(taken, [PAGE, "_k"], "left").withColumn("key", key).select(*keyed.drop("_k").columns, "key")


def alias_rank(label: Column, aliases: Sequence[str], numbered_labels: bool = False) -> Column:
    """Position of the alias a label stands for, NULL for none."""
    low = F.lower(label)
    rank = F.lit(None).cast("int")
    for position, alias in reversed(list(enumerate(aliases))):
        hit = low == alias.lower()
        if numbered_labels:
            hit |= low.startswith(alias.lower() + " ")
        rank = F.when(hit, position).otherwise(rank)
    return rank


def lookup_facts(
    facts: DataFrame, fields: dict[str, Sequence[str]], numbered_labels: bool = False,
    order: Sequence[str] = (),
) -> DataFrame:
    """First non-blank value among the aliases of each field, one row per page."""
    filled = F.trim("value") != ""
    out = []
    for field, aliases in fields.items():
        rank = alias_rank(F.col("label"), aliases, numbered_labels)
        at = F.struct(rank.alias("r"), *order)
        out.append(F.min_by("value", F.when(filled & rank.isNotNull(), at)).alias(field))
    return facts.groupBy(PAGE).agg(*out)


def split_values(value: Column | str, separators: str = ",;/|") -> Column:
    """Distinct parts of a fact value, case ignored, first spelling kept."""
    parts = F.transform(F.split(col(value), f"[{separators}]"), lambda p: F.trim(p))
    return distinct_ci(F.filter(parts, lambda p: p != ""))


def page_languages(facts: DataFrame, label_pattern: str = fixed.LANGUAGE_LABEL) -> DataFrame:
    """Languages a page's audio and subtitle facts give evidence of."""
    evidence = F.col("label").rlike(label_pattern)
    low = F.lower("value")
    found = [
        F.max(F.when(evidence & low.contains(part), F.lit(name))).alias(name)
        for part, name in fixed.LANGUAGES.items()
    ]
    rolled = facts.groupBy(PAGE).agg(F.max(evidence).alias("_e"), *found)
    names = F.array_compact(F.array(*[F.col(f"`{n}`") for n in fixed.LANGUAGES.values()]))
    return rolled.where("_e").select(PAGE, names.alias("languages"))


def named_languages(value: Column | str) -> Column:
    """Language names that start a part of a fact value."""
    parts = F.transform(F.split(col(value), "[,;/|]"), lambda p: F.trim(p))
    names = F.transform(parts, lambda p: match(p, fixed.LANGUAGE_NAME))
    return distinct_ci(F.array_compact(names))


def redact_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts without secrets and momentary readings, and a warning per redacted page."""
    sensitive = F.col("label").rlike(fixed.SENSITIVE_LABEL)
    momentary = F.col("label").rlike(fixed.TELEMETRY_LABEL)
    warnings = facts.where(sensitive).select(PAGE).distinct().withColumn(
        "warning", F.lit("sensitive_fact_redacted")
    )
    return facts.where(~sensitive & ~momentary), warnings


def without_telemetry(value: Column | str) -> Column:
    """Bar-separated text without momentary parts."""
    parts = F.transform(F.split(col(value), r"\|"), normalize_text)
    return F.array_join(F.filter(parts, lambda p: ~p.rlike(fixed.TELEMETRY_PART)), " ")


def visible_sections(sections: DataFrame) -> DataFrame:
    """Hidden page sections that may be kept: not empty, not telemetry, not sensitive."""
    title = F.coalesce("label", F.lit(""))
    dropped = title.rlike(fixed.TELEMETRY_PART) | title.rlike(fixed.SENSITIVE_PARAMETER)
    empty = (title == "") & (F.coalesce("value", F.lit("")) == "")
    return sections.where(~dropped & ~empty)


def categorize(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Types of each row's source category; rows of unknown categories are dropped."""
    return rows.join(categories, ["source", "category_id"])


def slug_type(category: Column | str) -> Column:
    """Type named by a category slug, NULL for none."""
    low = F.lower(col(category))
    out = F.lit(None).cast("string")
    for part, kind in reversed(fixed.CATEGORY_SLUGS):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def category_types(current: Column | str, category: Column | str) -> Column:
    """Types after a category was read; an episodic subtype found earlier stays."""
    kind, types = slug_type(category), col(current)
    keeps = ((kind == "multfilm") & F.array_contains(types, "multserial")) | (
        (kind == "documovie") & F.array_contains(types, "docuserial")
    )
    return F.when(kind.isNull() | F.coalesce(keeps, F.lit(False)), types).otherwise(F.array(kind))


def enrich(
    lists: DataFrame, details: DataFrame, keys: Sequence[str] = ("source", "source_key"),
    keep_bare: bool = True,
) -> DataFrame:
    """List rows with the facts of their detail rows laid over them.

    A fact the detail observed wins, masks add up, warnings are united. ``keep_bare`` keeps
    list rows without a detail row.
    """
    d = details.select(*keys, F.struct(*[c for c in details.columns if c not in keys]).alias("_d"))
    joined = lists.join(d, list(keys), "left" if keep_bare else "inner")
    inside = set(details.columns)
    masked = {c: f for f, cols in MASKED_COLUMNS.items() for c in cols}
    found = F.col("_d").isNotNull()
    out = []
    for name in lists.columns:
        if name in keys or name not in inside:
            out.append(F.col(name))
        elif name == "observed_fields":
            mask = F.col(name).bitwiseOR(F.coalesce(F.col("_d.observed_fields"), F.lit(0).cast("long")))
            out.append(mask.alias(name))
        elif name == "warnings":
            united = F.array_union(name, F.col("_d.warnings"))
            out.append(F.when(found, united).otherwise(F.col(name)).alias(name))
        elif name in masked:
            seen = F.coalesce(has(masked[name], F.col("_d.observed_fields")), F.lit(False))
            out.append(F.when(seen, F.col(f"_d.{name}")).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.when(found, F.col(f"_d.{name}")).otherwise(F.col(name)).alias(name))
    return joined.select(*out)


def merge_maps(first: Column | str, second: Column | str) -> Column:
    """Union of two maps, the second winning, without a session setting."""
    a, b = col(first), col(second)
    kept = F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))
    return F.map_concat(kept, b)
