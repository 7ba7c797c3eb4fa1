"""Personal data: fixed patterns, and terms that give a found entity away.

Patterns find the protected entities. The words around an entity are candidate terms, and corpus
co-occurrence estimates how strongly a term reveals it: with document counts, the mutual
information PMI(e; t) = log(n(t, e) n / (n(t) n(e))) as a share of the entity's own information
IC(e) = log(n / n(e)). From ``GENERALISE`` on a term is generalised, from ``REMOVE`` on it is
removed; it must stand near the entity in ``MIN_SUPPORT`` documents at least. All counts cover
the whole table; the document counts of terms come from a second scan that only looks at words
which a bitmap of fixed size may hold, so what tasks receive does not grow.

Cases: a null text counts as empty; a text without personal data has empty spans and the digest of
no bytes; texts are scanned whole; repeated rows count as documents of their own and give repeated
rows. An entity in every document reveals nothing and has no terms. Result columns replace others
of their name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm.arrays import ALNUM_WORD, LOWER, byte_class, pieces, rows_of, runs, stretch_hashes
from obscat.llm.bitmaps import bitmap, may_hold
from obscat.llm.registry import query, table
from obscat.llm.spans import Texts, digest, joined, replaced
from obscat.llm.store import written

# Parts of the patterns.
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *((ord(c), ord(c)) for c in "._%+-"))
DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS, LARGEST_PART = (16, 19), (8, 15), 255

KINDS = ("email", "ip", "card", "phone")
COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
CONTEXT_WORDS = 5
GENERALISE, REMOVE = 0.9, 0.99
MIN_SUPPORT = 2

_DIGIT = byte_class((0x30, 0x39))


def luhn(digits: bytes) -> bool:
    values = [d - 48 for d in reversed(digits)]
    return (sum(values[::2]) + sum(2 * d - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def emails(texts: Texts) -> list[tuple[str, int, int]]:
    out, buffer = [], texts.buffer
    at = np.flatnonzero(texts.data == 0x40)
    row = texts.row(at)
    free = 0
    for place, low, high in zip(at.tolist(), texts.offsets[row].tolist(), texts.offsets[row + 1].tolist()):
        low = max(low, free)
        start = place
        while start > low and LOCAL[buffer[start - 1]]:
            start -= 1
        match = DOMAIN.match(buffer, place + 1, high) if start < place else None
        free = match.end() if match else place + 1
        if match:
            out.append(("email", start, match.end()))
    return out


def addresses(texts: Texts) -> list[tuple[str, int, int]]:
    data, out, free = texts.data, [], 0
    if len(data) < 3:
        return out
    at = np.flatnonzero((data[1:-1] == 0x2E) & _DIGIT[data[:-2]] & _DIGIT[data[2:]]) + 1
    row = texts.row(at)
    same = row == texts.row(at + 1)
    same &= row == texts.row(at - 1)
    at, row = at[same], row[same]
    for place, low, high in zip(at.tolist(), texts.offsets[row].tolist(), texts.offsets[row + 1].tolist()):
        if place < free:
            continue
        start = place
        while start > low and _DIGIT[texts.buffer[start - 1]]:
            start -= 1
        match = DOTTED.match(texts.buffer, start, high)
        free = match.end()
        parts = match[0].split(b".")
        ends = start + np.cumsum([len(p) + 1 for p in parts]) - 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip(b"0")) <= 3 and int(p[-3:]) <= LARGEST_PART for p in parts[i : i + 4]):
                out.append(("ip", int(ends[i]) - len(parts[i]), int(ends[i + 3])))
    return out


def cards(texts: Texts) -> list[tuple[str, int, int]]:
    at = np.flatnonzero(_DIGIT[texts.data])
    if len(at) < CARD_DIGITS[0]:
        return []
    gap = np.diff(at)
    between = texts.data[at[:-1] + 1]
    row = texts.row(at)
    tied = ((gap == 1) | (gap == 2) & ((between == 0x20) | (between == 0x2D))) & (row[1:] == row[:-1])
    first = np.concatenate([[0], np.flatnonzero(~tied) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    size = last - first + 1
    fit = (size >= CARD_DIGITS[0]) & (size <= CARD_DIGITS[1])
    return [
        ("card", int(at[a]), int(at[b]) + 1) for a, b in zip(first[fit].tolist(), last[fit].tolist())
        if luhn(texts.data[at[a : b + 1]].tobytes())
    ]


def phones(texts: Texts) -> list[tuple[str, int, int]]:
    out = []
    at = np.flatnonzero(texts.data == 0x2B)
    row = texts.row(at)
    for place, high in zip(at.tolist(), texts.offsets[row + 1].tolist()):
        match = PHONE.match(texts.buffer, place, high)
        if match and PHONE_DIGITS[0] <= sum(48 <= b <= 57 for b in match[0]) <= PHONE_DIGITS[1]:
            out.append(("phone", place, match.end()))
    return out


def entities(texts: Texts) -> list[tuple[str, int, int]]:
    """All matches of the patterns, in bytes, by kind and start."""
    return emails(texts) + addresses(texts) + cards(texts) + phones(texts)


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words that can be terms."""
    data = LOWER[texts.data]
    starts, ends = runs(data, texts.offsets, ALNUM_WORD)
    return starts, ends, stretch_hashes(data, starts, ends)


def contexts(texts: Texts, found: list[tuple[str, int, int]]) -> dict[int, list[dict]]:
    """Per row the terms near its entities: hashes of both, and the term's place in code points."""
    starts, ends, hashes = word_hashes(texts)
    first = rows_of(starts, texts.offsets)
    spans = np.array([(s, e) for _, s, e in found], np.int64)
    row = texts.row(spans[:, 0])
    taken = np.zeros(len(texts.data) + 1, np.int32)
    for s, e in spans:
        taken[s] += 1
        taken[e] -= 1
    taken = np.concatenate([[0], np.cumsum(np.cumsum(taken[:-1]) > 0)])
    data = LOWER[texts.data]
    entity = stretch_hashes(data, spans[:, 0], spans[:, 1]).view(np.int64)
    out: dict[int, list[dict]] = {}
    for (s, e), r, name in zip(spans.tolist(), row.tolist(), entity.tolist()):
        a = np.searchsorted(ends, s, side="right")
        b = np.searchsorted(starts, e)
        near = np.arange(max(first[r], a - CONTEXT_WORDS), min(first[r + 1], b + CONTEXT_WORDS))
        near = near[taken[ends[near]] == taken[starts[near]]]
        where = texts.points(starts[near], np.full(len(near), r)), texts.points(ends[near], np.full(len(near), r))
        out.setdefault(r, []).extend(
            {"entity": name, "term": t, "s": p, "e": q}
            for t, p, q in zip(hashes[near].view(np.int64).tolist(), where[0].tolist(), where[1].tolist()))
    return out


_CONTEXT = "array<struct<entity:bigint,term:bigint,s:bigint,e:bigint>>"
_CONTEXT_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("entity", "term", "s", "e")]))


def _found(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = Texts(piece.column("text"))
                found = entities(texts)
                n = len(piece)
                counts = {k: np.zeros(n, np.int64) for k in KINDS}
                digests, spans, near = [digest("")] * n, [""] * n, [[]] * n
                for row, own in texts.by_row(found).items():
                    for k, _, _ in own:
                        counts[k][row] += 1
                    own.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                    spans[row] = joined(own)
                    digests[row] = digest(spans[row])
                for row, own in (contexts(texts, found) if found else {}).items():
                    near[row] = own
                arrays = [piece.column("kept"), *(pa.array(counts[k]) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(near, _CONTEXT_ARROW)]
                names = ["kept", *COLUMNS, "near"]
                if keep_text:
                    arrays.append(piece.column("text").cast(pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _document_counts(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = Texts(piece.column("text"))
                starts, _, hashes = word_hashes(texts)
                wanted = may_hold(bits.value, hashes)
                row, hashes = texts.row(starts[wanted]), hashes[wanted]
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                both, at = np.unique(np.concatenate([keys, hashes[fresh]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, np.ones(int(fresh.sum()), np.int64)]), len(both)).astype(np.int64)
                keys = both
                if len(keys) > 500_000:
                    yield pa.RecordBatch.from_pydict({"term": keys.view(np.int64), "n": counts})
                    keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_pydict({"term": keys.view(np.int64), "n": counts})

    return run


def find_pii(docs: DataFrame, text: str = "text", sanitise: bool = False) -> DataFrame:
    """Add ``n_email, n_ip, n_card, n_phone, base_sha256, spans`` to ``docs``.

    The text is dropped, or with ``sanitise`` kept with entities replaced by their kind,
    generalised terms by ``[term]``, and removed terms left out.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text and c.lower() not in COLUMNS]
    rows = docs.select(F.struct(*[docs[c] for c in others]).alias("kept"), docs[text].cast("string").alias("text"))
    kind = rows.schema["kept"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COLUMNS[:4])
    first = written(
        rows.mapInArrow(_found(sanitise), f"kept {kind}, {counts}, base_sha256 string, spans string, near {_CONTEXT}" + ", text string" * sanitise)
        .withColumn("row", F.monotonically_increasing_id()), "pii")
    near = first.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.*")
    near_terms = near.select("row", "entity", "term").distinct()
    together = near_terms.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= MIN_SUPPORT)
    of_entity = near.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    together = written(together.join(of_entity, "entity"), "pii-pairs")
    bits = spark.sparkContext.broadcast(bitmap(together, "term"))
    of_term = rows.select("text").mapInArrow(_document_counts(bits), "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    total = first.count()
    pmi = F.log(F.col("n_both") * F.lit(float(max(1, total))) / (F.col("n_term") * F.col("n_entity")))
    share = pmi / F.nullif(F.log(F.lit(float(max(1, total))) / F.col("n_entity")), F.lit(0.0))
    telling = (
        together.join(of_term, "term").withColumn("share", share).where(F.col("share") >= GENERALISE)
        .select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))
    )
    terms = (
        near.join(telling, ["entity", "term"]).groupBy("row", "s", "e").agg(F.max("action").alias("action"))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("action", "s", "e"))).alias("terms"))
    )
    found = first.drop("near").join(terms, "row", "left")
    more = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["action"], t["s"], t["e"])), ",")
    found = found.withColumn("spans", F.concat_ws(",", F.nullif("spans", F.lit("")), F.nullif(more, F.lit(""))))
    if not sanitise:
        return found.select("kept.*", *COLUMNS)
    return found.select("kept", *COLUMNS, "text").mapInArrow(_replaced, f"kept {kind}, {counts}, base_sha256 string, spans string, text string").select("kept.*", *COLUMNS, "text")


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = {k: f"[{k}]" for k in KINDS} | {"generalise": "[term]", "remove": ""}
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        for i, own in enumerate(spans):
            if own:
                texts[i] = replaced(texts[i], [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in own.split(","))], by)
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
