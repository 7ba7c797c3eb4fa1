"""Column functions over date texts. Unreadable dates are NULL; results carry no zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from obscat.functions import fixed
from obscat.functions.text import col, match, normalize_text


def _lookup(key: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, number in table.items():
        out = F.when(key == name, number).otherwise(out)
    return out


def _stamp(year, month, day, hour=None, minute=None, second=None) -> Column:
    zero = F.lit(0)
    number = lambda c: zero if c is None else F.coalesce(c.try_cast("int"), zero)
    return F.try_make_timestamp_ntz(
        year, month, day, number(hour), number(minute), number(second).cast("decimal(8,6)")
    )


def short_date(text: Column | str) -> Column:
    """``10 Май 24``; an unknown month counts as January, the year is 20yy."""
    parts = F.filter(F.split(normalize_text(text), r"[ & ]"), lambda p: p != "")
    day = F.coalesce(F.get(parts, F.lit(0)).try_cast("int"), F.lit(1))
    month = F.coalesce(_lookup(F.lower(F.get(parts, F.lit(1))), fixed.SHORT_MONTHS), F.lit(1))
    year = F.coalesce(F.get(parts, F.lit(2)).try_cast("int"), F.lit(0)) + 2000
    return F.when(F.size(parts) >= 3, _stamp(year, month, day))


def long_date(text: Column | str, offset_hours: int = 0) -> Column:
    """``10 мая 2024 в 12:30`` written at ``offset_hours`` from UTC."""
    part = lambda g: match(text, fixed.LONG_DATE_PATTERN, g)
    month = _lookup(F.lower(part(2)), fixed.GENITIVE_MONTHS)
    stamp = _stamp(part(3).cast("int"), month, part(1).cast("int"), part(4), part(5), part(6))
    return stamp - F.expr(f"INTERVAL {int(offset_hours)} HOURS")


def topic_date(text: Column | str) -> Column:
    """``22-Сен-26 03:19`` or ``10.05.24 10:35``, Russian or English month names."""
    pattern = r"(?iu)(\d{1,2})[\s.\-]+(\p{L}+|\d{1,2})\.?[\s.\-]+(\d{4}|\d{2})(?:\s+(\d{1,2}):(\d{2}))?"
    part = lambda g: match(text, pattern, g)
    head = F.lower(F.substring(part(2), 1, 3))
    named = _lookup(head, {**fixed.SHORT_MONTHS, "мая": 5, **fixed.ENGLISH_MONTHS})
    month = F.coalesce(named, part(2).try_cast("int"))
    year = part(3).cast("int")
    full = F.when(year >= 100, year).when(year < 50, year + 2000).otherwise(year + 1900)
    return _stamp(full, month, part(1).cast("int"), part(4), part(5))


def dashed_date(text: Column | str) -> Column:
    """``dd-MM-yyyy H:mm:ss`` anywhere in the text."""
    pattern = r"(\d{2})-(\d{2})-(\d{4})\s+(\d{1,2}):(\d{2}):(\d{2})"
    part = lambda g: match(text, pattern, g)
    return _stamp(part(3).cast("int"), part(2).cast("int"), part(1).cast("int"), part(4), part(5), part(6))


def dotted_date(text: Column | str) -> Column:
    """``dd.MM.yyyy HH:mm``, an ``в`` between date and time allowed."""
    pattern = r"(?iu)^(\d{2})\.(\d{2})\.(\d{4})(?: в)? (\d{2}):(\d{2})$"
    clean = normalize_text(text)
    part = lambda g: match(clean, pattern, g)
    return _stamp(part(3).cast("int"), part(2).cast("int"), part(1).cast("int"), part(4), part(5))


def unix_date(text: Column | str) -> Column:
    """Unix seconds within the accepted years."""
    low, high = fixed.UNIX_DATE_RANGE
    seconds = col(text).cast("string").try_cast("bigint")
    base = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    zero = F.lit(0)
    return F.when(
        (seconds > low) & (seconds < high), base + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    )


def utc_naive(instant: Column | str) -> Column:
    """Zone-less UTC reading of an instant, whatever the session zone."""
    zero = F.lit(0)
    seconds = (F.unix_micros(col(instant)).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(zero, zero, zero, seconds)


def utc_instant(naive: Column | str) -> Column:
    """Instant of a zone-less UTC reading, whatever the session zone."""
    c = col(naive)
    return F.make_timestamp_ltz(
        F.year(c), F.month(c), F.day(c), F.hour(c), F.minute(c),
        F.date_part(F.lit("SECOND"), c), F.lit("UTC"),
    )


def iso_date(text: Column | str) -> Column:
    """ISO-8601 with an offset, as UTC."""
    return utc_naive(F.try_to_timestamp(col(text)))
