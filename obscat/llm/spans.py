"""Places in whole texts: bytes of many texts at once, results in code points of their own text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from obscat.llm.arrays import text_bytes


class Texts:
    """The texts of a piece as one buffer."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        self.buffer = self.data.tobytes()
        self._points: np.ndarray | None = None

    def row(self, at: np.ndarray) -> np.ndarray:
        """Row of every byte position."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def points(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Code points between the start of the row's text and the byte position."""
        if self._points is None:
            self._points = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int64)])
        return self._points[at] - self._points[self.offsets[row]]

    def by_row(self, found: list[tuple[str, int, int]]) -> dict[int, list[tuple[str, int, int]]]:
        """Byte spans ``(kind, start, end)`` as spans in code points, by row."""
        out: dict[int, list[tuple[str, int, int]]] = {}
        if found:
            start, end = (np.array([x[i] for x in found], np.int64) for i in (1, 2))
            row = self.row(start)
            a, b = self.points(start, row), self.points(end, row)
            for kind, r, s, e in zip([x[0] for x in found], row.tolist(), a.tolist(), b.tolist()):
                out.setdefault(r, []).append((kind, s, e))
        return out


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def replaced(text: str, spans: Iterable[tuple[str, int, int]], by: dict[str, str]) -> str:
    """``text`` with every span replaced by its kind's stand-in; overlapping spans become one."""
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], by[kind]]
        at = end
    return "".join([*out, text[at:]])
