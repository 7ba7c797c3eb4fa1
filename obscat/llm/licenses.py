"""Licence scan with a generalised suffix automaton over the words of licence templates.

The driver builds one automaton over all templates; its size depends on them alone. Tasks map
words to template word numbers (any other word ends a match), and stream stretches of known words
through the automaton: per word the longest stretch ending there that occurs in a template.
Stretches that cannot grow are the long matches; matches of a template in rising order, near one
another, chain to a covered span of it. A chain that covers ``MIN_COVER`` of a template gives its
label; a phrase is a template that must be covered whole, and its places are the base matches.

Cases: a null text counts as empty; a text without words or matches has no labels, score 0 and
null first and last word; texts are scanned whole; repeated rows give repeated rows; result
columns replace others of their name. Labels are distinct and sorted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm.arrays import ALNUM_WORD, LOWER, pieces, rows_of, runs, stretch_hashes, text_bytes
from obscat.llm.registry import query, table

# Phrases whose places are counted, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Short licence notices, with their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license", "gpl-3"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)

COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
#: Share of a notice that a chain must cover, words of a match that may be part of a chain, and
#: words that a text may put between two matches of a chain.
MIN_COVER = 0.8
MIN_MATCH = 3
MAX_GAP = 8


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: ``(template, end)`` of the stretches that this state is the first to hold.
    ends: list[tuple[int, int]] = field(default_factory=list)


class SuffixAutomaton:
    """All stretches of words of a set of templates, one state per set of places."""

    def __init__(self, templates: list[list[int]]):
        self.templates = templates
        self.states = [State(0)]
        for number, template in enumerate(templates):
            at = 0
            for place, word in enumerate(template):
                at = self._extend(at, word)
                self.states[at].ends.append((number, place + 1))
        for state in sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length):
            link = self.states[state].link
            if link > 0:
                self.states[link].ends = sorted({*self.states[link].ends, *self.states[state].ends})

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        have = states[last].next.get(word)
        if have is not None:
            return have if states[have].length == states[last].length + 1 else self._split(last, have, word)
        new = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].next:
            states[at].next[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            have = states[at].next[word]
            states[new].link = have if states[have].length == states[at].length + 1 else self._split(at, have, word)
        return new

    def _split(self, at: int, state: int, word: int) -> int:
        """Give the shorter stretches of ``state``, those that ``at`` leads to, a state of their own."""
        states = self.states
        old = states[state]
        states.append(State(states[at].length + 1, old.link, dict(old.next)))
        old.link = copy = len(states) - 1
        while at >= 0 and states[at].next.get(word) == state:
            states[at].next[word] = copy
            at = states[at].link
        return copy

    def matching(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """Per word the state and the length of the longest stretch that ends with it."""
        states, at, length = self.states, 0, 0
        for word in words:
            while at and word not in states[at].next:
                at = states[at].link
                length = states[at].length
            to = states[at].next.get(word)
            at, length = (0, 0) if to is None else (to, length + 1)
            yield at, length


class Scanner:
    """Phrases and notices as one automaton and the numbers of their words."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = len(phrases)
        every = [*phrases, *notices]
        self.labels = [label for _, label in every]
        tokens = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower().encode()) for text, _ in every]
        vocabulary = sorted({w for t in tokens for w in t})
        joined, ends = b"".join(vocabulary), np.cumsum([len(w) for w in vocabulary])
        hashes = stretch_hashes(np.frombuffer(joined, np.uint8), ends - [len(w) for w in vocabulary], ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        place = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = SuffixAutomaton([[place[w] for w in t] for t in tokens])
        self.sizes = [len(t) for t in tokens]

        #: Per state the phrases that a stretch ending there may end with.
        self.whole: list[list[tuple[int, int]]] = []
        for state in self.automaton.states:
            found = []
            while state.link >= 0:
                found += [(t, end) for t, end in state.ends if t < self.phrases and end == self.sizes[t] <= state.length]
                state = self.automaton.states[state.link]
            self.whole.append(sorted(set(found)))

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Template word number of every word, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def scan(self, words: list[int], start: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base places ``(start, phrase)`` and long matches ``(start, end, template, template end)`` of a stretch."""
        places, matches, states = [], [], self.automaton.states
        steps = list(self.automaton.matching(words))
        for i, (at, length) in enumerate(steps):
            if length < MIN_MATCH:
                continue
            places += [(start + i + 1 - size, t) for t, size in self.whole[at] if size <= length]
            if i + 1 < len(steps) and steps[i + 1][1] > length:
                continue
            matches += [(start + i + 1 - length, start + i + 1, t, e) for t, e in states[at].ends]
        return places, matches

    def covers(self, matches: list[tuple[int, int, int, int]]) -> dict[int, float]:
        """Best share of every template that a chain of matches covers."""
        best: dict[int, float] = {}
        chain: dict[int, tuple[int, int, int]] = {}
        for start, end, template, there in matches:
            size = end - start
            before = chain.get(template)
            if before and before[1] <= there - size and 0 <= start - before[0] <= MAX_GAP:
                covered = before[2] + size
            elif before and before[0] == end and before[2] >= size:
                continue
            else:
                covered = size
            chain[template] = end, there, covered
            best[template] = max(best.get(template, 0.0), covered / self.sizes[template])
        return best


def scan_licences(docs: DataFrame, text: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Add ``n_words, n_base, first_word, last_word, base_labels, labels, score`` to ``docs``; drops the text."""
    others = [c for c in docs.columns if c != text and c.lower() not in COLUMNS]
    rows = docs.select(F.struct(*[docs[c] for c in others]).alias("kept"), docs[text].cast("string").alias("text"))
    kind = rows.schema["kept"].dataType.simpleString()
    scanner = Scanner(phrases, notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield _scanned(piece, scanner)

    return rows.mapInArrow(
        run, f"kept {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    ).select("kept.*", *COLUMNS)


def _scanned(piece: pa.RecordBatch, scanner: Scanner) -> pa.RecordBatch:
    data, offsets = text_bytes(piece.column("text"))
    data = LOWER[data]
    starts, ends = runs(data, offsets, ALNUM_WORD)
    first = rows_of(starts, offsets)
    numbers = scanner.word_numbers(stretch_hashes(data, starts, ends))
    n = len(piece)
    places: dict[int, list[tuple[int, int]]] = {}
    matches: dict[int, list[tuple[int, int, int, int]]] = {}
    known = np.where(numbers >= 0, 1, 0).astype(np.uint8)
    a, b = runs(known, first, np.array([False, True] + [False] * 254))
    long = b - a >= MIN_MATCH
    row = np.searchsorted(first, a[long], side="right") - 1
    for r, start, end in zip(row.tolist(), a[long].tolist(), b[long].tolist()):
        found, more = scanner.scan(numbers[start:end].tolist(), start - int(first[r]))
        if found:
            places.setdefault(r, []).extend(found)
        if more:
            matches.setdefault(r, []).extend(more)
    counts = np.zeros(n, np.int64)
    low, high, base, labels, score = [None] * n, [None] * n, [""] * n, [""] * n, np.zeros(n)
    for r in places.keys() | matches.keys():
        here = places.get(r, [])
        covers = scanner.covers(matches.get(r, []))
        own = {scanner.labels[t] for _, t in here}
        if here:
            counts[r], low[r], high[r] = len(here), min(here)[0], max(here)[0]
        more = {scanner.labels[t] for t, share in covers.items() if t >= scanner.phrases and share >= MIN_COVER}
        base[r], labels[r] = ",".join(sorted(own)), ",".join(sorted(own | more))
        score[r] = 1.0 if here else min(1.0, max(covers.values(), default=0.0))
    return pa.RecordBatch.from_arrays([
        piece.column("kept"), pa.array(np.diff(first).astype(np.int64)), pa.array(counts), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
        pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score),
    ], names=["kept", *COLUMNS])


@query("op9_licenses")
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
