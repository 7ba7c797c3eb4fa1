"""Ordered work per key in slices, so that no key has to fit one task.

A sketch over the keys (frequent items) names those with more than ``HEAVY_ROWS`` rows and more than one
in ``MOST_HEAVY`` of all; there can be no more than ``MOST_HEAVY`` of them. Quantile sketches of their order
give bounds, and the number of bounds below a row is its slice. So the slice is a function of the row alone:
it is the same wherever a plan computes it, costs no shuffle, and any bounds give the same results. Rows of all
other keys are in slice 0.

Work runs per (key, slice), with one shuffle; only heavy keys have slices to put together, and these are
few rows of a known number (``MOST_HEAVY`` times ``SLICES``), which may be broadcast.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = "_slice"
#: Rows of a key that one task works on, and slices of a key with more.
HEAVY_ROWS = 1_000_000
SLICES = 64
#: Most keys that are cut, and items that the sketch follows to find them.
MOST_HEAVY = 1_000
TRACKED = 10_000


def _image(by: Column, kind: T.DataType, low, high) -> Column:
    """A long that never falls as ``by`` rises: eight bytes after the beginning that all texts share."""
    if not isinstance(kind, T.StringType):
        return by.cast("long")
    shared = len(os.path.commonprefix([low or "", high or ""]).encode())
    piece = F.hex(F.substring(F.encode(by, "UTF-8"), shared + 1, 7))
    return F.conv(F.rpad(piece, 14, "0"), 16, 10).cast("long")


def heavy_keys(told: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys with more than ``HEAVY_ROWS`` rows and more than one in ``MOST_HEAVY`` of all."""
    rows = told.count()
    if rows <= HEAVY_ROWS:
        return []
    top = told.select(F.xxhash64(*keys).alias("_h")).agg(F.expr(f"approx_top_k(_h, {MOST_HEAVY}, {TRACKED})").alias("top")).first()["top"]
    return [r["item"] for r in top or [] if r["count"] > max(HEAVY_ROWS, rows // MOST_HEAVY)]


class Slices:
    """Rows with their slice in ``rows``; ``cut`` tells whether any key has more than one."""

    def __init__(self, df: DataFrame, keys: Sequence[str], by: Column | str, raw: tuple[DataFrame, Sequence[str]] | None = None):
        """``by`` is a text or a whole number that never falls along the order inside a key; null is lowest.

        ``raw`` names rows that are cheaper to sketch and hold all of ``df``, and some of the keys to tell them by.
        """
        self.keys = list(keys)
        # told by all their keys there are at most MOST_HEAVY heavy ones; raw keys may hold any number of others
        self.few = raw is None
        by = F.col(by) if isinstance(by, str) else by
        told, names = (df, self.keys) if raw is None else raw
        asked = told.select(F.xxhash64(*names).alias("_h"), by.alias("_by"))
        kind = asked.schema["_by"].dataType
        seen = asked.agg(
            F.expr(f"approx_top_k(_h, {MOST_HEAVY}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"),
            F.min("_by").alias("low"), F.max("_by").alias("high"),
        ).first()
        least = max(HEAVY_ROWS, seen["n"] // MOST_HEAVY)
        hot = [r["item"] for r in seen["top"] or [] if r["count"] > least]
        self.cut = bool(hot)
        if not hot:
            self.rows = df.withColumn(SLICE, F.lit(0))
            return
        image = lambda c: F.coalesce(_image(c, kind, seen["low"], seen["high"]), F.lit(-(1 << 63)))
        steps = [i / SLICES for i in range(1, SLICES)]
        bounds = asked.where(F.col("_h").isin(hot)).groupBy("_h").agg(F.percentile_approx(image(F.col("_by")), steps, 10_000).alias("_bounds")).collect()
        table = df.sparkSession.createDataFrame([tuple(r) for r in bounds], "_h long, _bounds array<bigint>")
        joined = df.withColumn("_h", F.xxhash64(*names)).join(F.broadcast(table), "_h", "left")
        here = image(by)
        number = F.when(F.col("_bounds").isNotNull(), F.size(F.filter("_bounds", lambda b: b < here)) + 1).otherwise(0)
        self.rows = joined.withColumn(SLICE, number).drop("_h", "_bounds")

    def light(self) -> DataFrame:
        return self.rows.where(F.col(SLICE) == 0)

    def heavy(self) -> DataFrame:
        return self.rows.where(F.col(SLICE) > 0)

    def summed(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Add the columns of a ``summary`` per heavy (key, slice) to ``rows``; NULL where a row's slice has none."""
        names = [*self.keys, SLICE]
        renamed = summary.select(*[F.col(k).alias(f"_s_{k}") for k in names], *[c for c in summary.columns if c not in names])
        same = F.lit(True)
        for k in names:
            same = same & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        return rows.join(F.broadcast(renamed) if self.few else renamed, same, "left").drop(*[f"_s_{k}" for k in names])


def earlier_slices(keys: Sequence[str]):
    """Window over the slices of a key before each one."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, by: Column | str, raw: tuple[DataFrame, Sequence[str]] | None = None) -> DataFrame:
    """Add the position of every row inside its key group, from 1; ``by`` and ``raw`` as in :class:`Slices`."""
    keys = list(keys)
    slices = Slices(df, keys, by, raw)
    position = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order)).cast("long")
    rows = slices.rows.withColumn(name, position)
    if slices.cut:
        offsets = (
            slices.heavy().groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
            .select(*keys, SLICE, F.sum("_rows").over(earlier_slices(keys)).alias("_offset"))
        )
        rows = slices.summed(rows, offsets).withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
    return rows.select(*df.columns, name)
