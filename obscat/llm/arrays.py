"""Whole columns of texts as byte arrays: words, hashes and shingles without a loop over words.

A piece holds the texts of some rows back to back. All helpers work on the UTF-8 bytes, so a
class of ASCII characters is a table of 256 flags and every byte of a non-ASCII character falls
into the class that the table gives to bytes from 128 up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """Table of 256 flags that holds for the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return ~table if inverse else table


#: Everything but blanks, tabs and line ends.
WORD = byte_class((0x20, 0x20), (0x09, 0x0D), inverse=True)
#: ASCII digits and lower-case letters, and everything that is not ASCII.
ALNUM_WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inverse=True)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text, or one row where that has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a text column, offsets from 0; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of bytes in the class; none crosses two texts."""
    mask = table[data]
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(mask) + 1, bool)
    edge[0], edge[-1] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    joined = np.unique(inner[mask[inner] & mask[inner - 1]]) if len(inner) else inner
    at = np.flatnonzero(edge)
    if len(joined):
        at = np.sort(np.concatenate([at, joined, joined]))
    return at[0::2], at[1::2]


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every row the index of its first stretch, and one closing entry."""
    return np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = np.full(1 << max(16, int(n).bit_length()), _P if kind == "up" else _P_INVERSE, np.uint64)
        base[0] = 1
        _powers[kind] = np.cumprod(base)
    return _powers[kind][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretch_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every stretch; equal bytes have equal hashes wherever they stand."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", len(data)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _power("down", len(data) + 1)[starts])


_ROUND = [np.uint64(int(x)) for x in np.random.default_rng(11).integers(1 << 62, 1 << 63, 64) | 1]


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` hashes in a row, whatever rows they are in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * _ROUND[i % 64]
    return mixed(out)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, bounds)``: the ``k``-word shingles of every row, in order, with repeats.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    counts = np.diff(first)
    together = sequence_hash(hashes, k)
    values = np.zeros(len(hashes), np.uint64)
    values[: len(together)] = together
    keep = np.zeros(len(hashes) + 1, np.int8)
    long = np.flatnonzero(counts >= k)
    np.add.at(keep, first[long], 1)
    np.add.at(keep, first[long + 1] - k + 1, -1)
    keep = np.cumsum(keep[:-1]) > 0
    for row in np.flatnonzero((counts > 0) & (counts < k)):
        at = first[row]
        values[at] = sequence_hash(hashes[at : first[row + 1]], int(counts[row]))[0]
        keep[at] = True
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return values[keep], np.concatenate([[0], np.cumsum(sizes)])


def words(column: pa.Array, table: np.ndarray = WORD) -> tuple[np.ndarray, ...]:
    """``(bytes in lower case, starts, ends, first)`` of the words of a text column."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends = runs(data, offsets, table)
    return data, starts, ends, rows_of(starts, offsets)
