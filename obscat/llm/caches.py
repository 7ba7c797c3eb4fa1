"""What a reused Python worker keeps between tasks: the cache of one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, object] = {}
#: The C library's call that gives freed memory back; None where it has no such call.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return the memory that earlier tasks of this worker have freed: it stays with the allocators otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def only(name: str | None, make: Callable[[], object] | None = None):
    """The cache called ``name``, made if it isn't there; caches of other names are let go, all of them for None."""
    for other in [k for k in _held if k != name]:
        del _held[other]
    if name not in _held:
        give_back()
    if name is None:
        return None
    if name not in _held:
        _held[name] = make()
        give_back()
    return _held[name]
