"""Secret scan: fixed rules and two character Markov models.

The rules' matches are labelled samples of secrets, all other runs of identifier characters are
samples of ordinary identifiers; both come from the whole table. Tasks sum character pairs of each
kind, Spark adds the sums up, and two matrices of 68 by 68 counts are the models. A run of at
least ``MIN_RUN`` characters with letters and digits that no rule has found is a secret of kind
``random`` where its mean log-likelihood ratio per character exceeds ``MARGIN``.

Cases: a null text counts as empty; a text without a secret has empty spans and the digest of no
bytes; texts are scanned whole; repeated rows give repeated rows. Result columns replace others of
their name. Without any labelled secret no run is of kind ``random``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm.arrays import byte_class, pieces, runs
from obscat.llm.registry import query, table
from obscat.llm.spans import Texts, digest, joined, replaced

# The rules' patterns.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORD = re.compile(rb"(?i:password|passwd|secret|token|api_?key)\Z")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORD_BYTES = 8
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

KINDS = ("assign", "access", "hex", "random")
COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
MIN_RUN = 20
MIN_SAMPLE = 6
MARGIN = 0.25
#: Weight of a character's own frequency beside its frequency after the one before.
PRIOR = 100.0
SYMBOLS = 68

_HEX = byte_class((0x30, 0x39), (0x61, 0x66))
_IDENTIFIER = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), *((ord(c), ord(c)) for c in "+/_=-"))
_SEPARATOR = byte_class((ord(":"), ord(":")), (ord("="), ord("=")))
_BEFORE = byte_class(*((ord(c), ord(c)) for c in "dDtTnNyY\"' "))
_DIGIT, _LETTER = byte_class((0x30, 0x39)), byte_class((0x41, 0x5A), (0x61, 0x7A))
_CODE = np.full(256, 67, np.int64)
_CODE[np.flatnonzero(_IDENTIFIER)] = np.arange(int(_IDENTIFIER.sum()))


def rule_matches(texts: Texts) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, start of the value)`` of the rules' matches, in bytes."""
    buffer, data = texts.buffer, texts.data
    out = []
    at = np.flatnonzero(_SEPARATOR[data])
    at = at[(at > 0)]
    at = at[_BEFORE[data[at - 1]]]
    row = texts.row(at)
    taken, taken_row = 0, -1
    for place, r, low, high in zip(at.tolist(), row.tolist(), texts.offsets[row].tolist(), texts.offsets[row + 1].tolist()):
        end = place
        while end > low and buffer[end - 1] == 0x20:
            end -= 1
        if end > low and buffer[end - 1] in b"\"'":
            end -= 1
        word = KEYWORD.search(buffer[max(low, end - KEYWORD_BYTES) : end])
        if word is None:
            continue
        start = end - len(word[0])
        if r == taken_row and start < taken:
            continue
        match = ASSIGN.match(buffer, start, high)
        if match is None:
            continue
        taken, taken_row = match.end(), r
        if match.end() - match.start(1) >= MIN_VALUE:
            out.append(("assign", start, match.end(), match.start(1)))
    place = buffer.find(b"AKIA")
    while place >= 0:
        high = int(texts.offsets[texts.row(np.array([place]))[0] + 1])
        match = ACCESS.match(buffer, place, high)
        if match and match.end() - place >= MIN_ACCESS:
            out.append(("access", place, match.end(), place))
        place = buffer.find(b"AKIA", match.end() if match else place + 1)
    starts, ends = runs(data, texts.offsets, _HEX)
    long = ends - starts >= MIN_HEX
    out += [("hex", s, e, s) for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    return out


def _covered(texts: Texts, found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Running count of bytes inside matches."""
    change = np.zeros(len(texts.data) + 1, np.int32)
    for _, start, end, _ in found:
        change[start] += 1
        change[end] -= 1
    return np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])


def pair_counts(texts: Texts) -> np.ndarray:
    """Character pairs of secret values (row 0) and of ordinary identifiers (row 1)."""
    found = rule_matches(texts)
    starts, ends = runs(texts.data, texts.offsets, _IDENTIFIER)
    covered = _covered(texts, found)
    plain = (ends - starts >= MIN_SAMPLE) & (covered[ends] == covered[starts])
    out = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    if len(texts.data) < 2:
        return out
    change = np.zeros(len(texts.data) + 1, np.int32)
    np.add.at(change, starts[plain], 1)
    np.add.at(change, ends[plain] - 1, -1)
    inside = np.cumsum(change[:-1])[:-1] > 0
    codes = _CODE[texts.data]
    pairs = codes[:-1] * SYMBOLS + codes[1:]
    out[1] = np.bincount(pairs[inside], minlength=SYMBOLS * SYMBOLS)
    for _, _, end, value in found:
        out[0] += np.bincount(pairs[value : end - 1], minlength=SYMBOLS * SYMBOLS)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
    for batch in batches:
        for piece in pieces(batch, "text"):
            total += pair_counts(Texts(piece.column("text")))
    at = np.flatnonzero(total.ravel())
    yield pa.RecordBatch.from_pydict({"pair": at, "n": total.ravel()[at]})


def train(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of every character pair, random against ordinary; 2 * 68 * 68 sums reach the driver."""
    sums = docs.select(docs[text].cast("string").alias("text")).mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * SYMBOLS * SYMBOLS)
    counts[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    if not counts[: SYMBOLS * SYMBOLS].any():
        return np.full((SYMBOLS, SYMBOLS), -np.inf)
    counts = counts.reshape(2, SYMBOLS, SYMBOLS)
    single = counts.sum(axis=1, keepdims=True) + 1
    single /= single.sum(axis=2, keepdims=True)
    logs = np.log((counts + PRIOR * single) / (counts.sum(axis=2, keepdims=True) + PRIOR))
    return logs[0] - logs[1]


def random_runs(texts: Texts, ratio: np.ndarray, found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that look random and that no rule has found."""
    starts, ends = runs(texts.data, texts.offsets, _IDENTIFIER)
    long = ends - starts >= MIN_RUN
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return []
    covered = _covered(texts, found)
    out = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        data = texts.data[start:end]
        if covered[end] > covered[start] or not _DIGIT[data].any() or not _LETTER[data].any():
            continue
        codes = _CODE[data]
        if ratio[codes[:-1], codes[1:]].mean() > MARGIN:
            out.append(("random", start, end))
    return out


def find_secrets(docs: DataFrame, training: DataFrame | None = None, text: str = "text", redact: bool = False) -> DataFrame:
    """Add ``n_assign, n_access, n_hex, base_sha256, spans`` to ``docs``.

    The text is dropped, or with ``redact`` kept with every secret replaced by ``[secret]``.
    """
    ratio = train(docs if training is None else training, text)
    others = [c for c in docs.columns if c != text and c.lower() not in COLUMNS]
    rows = docs.select(F.struct(*[docs[c] for c in others]).alias("kept"), docs[text].cast("string").alias("text"))
    kind = rows.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield _scanned(piece, ratio, redact)

    out = rows.mapInArrow(run, f"kept {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", text string" * redact)
    return out.select("kept.*", *COLUMNS, *["text"] * redact)


def _scanned(piece: pa.RecordBatch, ratio: np.ndarray, redact: bool) -> pa.RecordBatch:
    texts = Texts(piece.column("text"))
    found = rule_matches(texts)
    base = texts.by_row([x[:3] for x in found])
    more = texts.by_row(random_runs(texts, ratio, found))
    order = {k: i for i, k in enumerate(KINDS)}
    n = len(piece)
    counts = {k: np.zeros(n, np.int64) for k in KINDS[:3]}
    digests, spans = [digest("")] * n, [""] * n
    changed = {}
    for row in base.keys() | more.keys():
        first = sorted(base.get(row, []), key=lambda s: (s[1], order[s[0]]))
        for k, _, _ in first:
            counts[k][row] += 1
        every = sorted(first + more.get(row, []), key=lambda s: (s[1], order[s[0]]))
        digests[row], spans[row] = digest(joined(first)), joined(every)
        changed[row] = every
    arrays = [piece.column("kept"), *(pa.array(counts[k]) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
    if redact:
        whole = piece.column("text")
        if changed:
            whole = whole.to_pylist()
            for row, every in changed.items():
                whole[row] = replaced(whole[row], every, dict.fromkeys(KINDS, "[secret]"))
            whole = pa.array(whole, pa.string())
        arrays.append(whole.cast(pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=["kept", *COLUMNS, *["text"] * redact])


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
