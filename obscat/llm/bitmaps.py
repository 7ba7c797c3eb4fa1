"""A bitmap of fixed size for the hashes of a table: what its tasks can leave out before a join.

It never leaves out a hash of the table. The larger the table, the less it leaves out; its size
stays the same, so it may be broadcast whatever the table holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 1 << 23


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """Set the bit of every hash in ``column``, a long."""
    bit = F.pmod(F.col(column), F.lit(BITMAP_BITS))
    words = (
        hashes.select(F.shiftright(bit, 5).alias("w"), F.expr(f"shiftleft(1L, CAST(pmod({column}, 32) AS INT))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of every hash (unsigned 64 bits) is set."""
    at = hashes & np.uint64(BITMAP_BITS - 1)
    return (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
