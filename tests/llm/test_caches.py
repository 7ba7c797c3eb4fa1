import re
from pathlib import Path

import numpy as np

from obscat.llm import caches


def resident():
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_memory_of_earlier_tasks_is_returned():
    # pieces below the size that the C library maps by itself, with every thousandth one still in use
    pieces = [np.ones(12_000) for _ in range(3_000)]
    pins = pieces[::1000] + pieces[-1:]
    before = resident()
    del pieces
    caches.only(None)
    assert before - resident() > 200 and len(pins) == 4


def test_one_cache_is_held():
    first = caches.only("a", lambda: [1])
    assert caches.only("a", lambda: [2]) is first
    assert caches.only("b", lambda: [3]) == [3] and caches.only("a", lambda: [4]) == [4]
    caches.only(None)
    assert not caches._held
