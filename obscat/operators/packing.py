"""Rows in a smaller shape for a shuffle, and back again.

Most bytes of a shuffled row are not its values but the places, lengths and paddings of its texts, and digits of
hashes that no compression finds again. Packed rows hold all texts and lists of texts in one text, and hashes
as bytes; a text that repeats another column (an address with its key) names it by a mark. Nothing is lost: a row whose values
hold a mark, or are no UTF-8, has every value spelled in hexadecimal digits.

Texts that are packed into one can't be left out of the shuffle one by one, so pack whole ``rows`` only where most columns
are read. Elsewhere pack ``hashes`` and the texts that repeat a column, each by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS, _ODD = "_texts", "_odd"
#: Between columns, between values of a list, for no value, for an empty list, for the column that a text repeats.
_NEXT, _AND, _NONE, _EMPTY, _SAME = "\x1e", "\x1d", "\x1c", "\x1b", "\x1a"
#: No list; a list of one missing value is ``_NONE``.
_NO_LIST = _NONE + _NONE
#: Texts that often hold another column.
REPEATS = {"link": "entity_hash", "source_url": "source_key"}
#: Columns that often hold hexadecimal digits.
DIGITS = ("entity_hash", "arrival_key")
ROWS, HASHES = "rows", "hashes"


def as_bytes(text: Column) -> Column:
    """A text as bytes, of half its size where it is lower hexadecimal digits."""
    digits = F.unhex(text)
    return F.when(text == F.lower(F.hex(digits)), F.concat(F.lit(b"\1"), digits)).otherwise(F.concat(F.lit(b"\0"), text.cast("binary")))


def as_text(data: Column) -> Column:
    """The text that :func:`as_bytes` has packed."""
    rest = F.substring(data, 2, 0x7FFFFFFF)
    return F.when(F.substring(data, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def _shorter(text: str, other: str) -> Column:
    """A text without what it repeats; one with a mark of its own stands after another mark as it is."""
    marked = F.contains(text, F.lit(_SAME)) | F.startswith(text, F.lit(_NONE))
    return F.when(marked, F.concat(F.lit(_NONE), text)).otherwise(_without(text, other))


def _longer(text: str, other: str) -> Column:
    return F.when(F.startswith(text, F.lit(_NONE)), F.substring(text, 2, 0x7FFFFFFF)).otherwise(_with(F.col(text), other))


def _without(text: str, other: str) -> Column:
    return F.replace(text, F.coalesce(other, F.lit("")), F.lit(_SAME))


def _with(text: Column, other: str) -> Column:
    return F.replace(text, F.lit(_SAME), F.coalesce(other, F.lit("")))


def shuffled(rows: DataFrame, keys: Sequence[str], pack: str | None = ROWS) -> DataFrame:
    """``rows`` dealt by ``keys``, on their way packed as ``pack`` says."""
    if pack is None:
        return rows.repartition(*keys)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    digits = [c for c in DIGITS if c not in keys and kinds.get(c) == T.StringType()]
    texts = [c for c, k in kinds.items() if k == T.StringType() and c not in (*keys, *digits)]
    lists = [c for c, k in kinds.items() if k == T.ArrayType(T.StringType())]
    other = {c: o for c, o in REPEATS.items() if c in texts and kinds.get(o) == T.StringType() and o not in texts}
    if pack == HASHES or len(texts) + len(lists) < 2:
        short = rows.withColumns({c: as_bytes(F.col(c)) for c in digits} | {c: _shorter(c, o) for c, o in other.items()}).repartition(*keys)
        return short.withColumns({c: as_text(F.col(c)) for c in digits}).withColumns({c: _longer(c, o) for c, o in other.items()})
    shorter = {c: _without(c, o) for c, o in other.items()}
    listed = lambda values: F.array_join(values, _AND, _NONE)
    plain = [F.coalesce(shorter.get(c, F.col(c)), F.lit(_NONE)) for c in texts]
    plain += [F.when(F.size(c) == 0, _EMPTY).otherwise(F.coalesce(listed(F.col(c)), F.lit(_NO_LIST))) for c in lists]
    spelled = [F.coalesce(F.hex(F.col(c).cast("binary")), F.lit(_NONE)) for c in texts]
    spelled += [F.when(F.size(c) == 0, _EMPTY).otherwise(F.coalesce(listed(F.transform(c, lambda v: F.hex(v.cast("binary")))), F.lit(_NO_LIST))) for c in lists]
    held = F.concat_ws("", *texts, *lists)
    odd = held.rlike("[\x1a-\x1e]") | ~F.is_valid_utf8(held)
    rest = [c for c in rows.columns if c not in (*texts, *lists, *digits)]
    packed = rows.select(
        *rest, *[as_bytes(F.col(c)).alias(c) for c in digits], odd.alias(_ODD),
        F.when(odd, F.concat_ws(_NEXT, *spelled)).otherwise(F.concat_ws(_NEXT, *plain)).alias(_TEXTS),
    )
    met = packed.repartition(*keys)
    met = met.select(*rest, *[as_text(F.col(c)).alias(c) for c in digits], _ODD, F.split(_TEXTS, _NEXT).alias(_TEXTS))
    at = {c: F.get(_TEXTS, F.lit(i)) for i, c in enumerate([*texts, *lists])}
    read = lambda digits: F.unhex(digits).cast("string")
    out = {}
    for c in texts:
        text = F.nullif(at[c], F.lit(_NONE))
        whole = _with(text, other[c]) if c in other else text
        out[c] = F.when(F.col(_ODD), read(text)).otherwise(whole)
    for c in lists:
        values = F.split(at[c], _AND)
        some = F.when(F.col(_ODD), F.transform(values, lambda v: read(F.nullif(v, F.lit(_NONE))))).when(
            F.contains(at[c], F.lit(_NONE)), F.transform(values, lambda v: F.nullif(v, F.lit(_NONE)))).otherwise(values)
        out[c] = F.when(at[c] == _EMPTY, F.array().cast("array<string>")).when(at[c] != _NO_LIST, some)
    return met.select(*[out.get(c, F.col(c)).alias(c) for c in rows.columns])
