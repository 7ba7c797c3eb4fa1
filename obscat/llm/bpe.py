"""BPE encoding and decoding by a trie of distinct words.

Tasks split their texts at white space, which no token crosses, and look every piece up in a
table of those already encoded. The words of new pieces go through the trie in depth-first order:
sorted distinct words are that order, and the stack holds the states of the current word's
prefixes. The state of a prefix is the last token of its encoding. By the rule of BPE that an
encoding is right where each token and the next one stay apart when merged alone, the last token
of a longer prefix is the one suffix token that stays apart from the state it follows, so a shared
prefix is worked on once and a word's tokens are read off from its end backwards.

The vocabulary file is a parameter; the driver reads it and broadcasts its text, whose size does
not depend on the data. Scans stay narrow: no shuffle.

Cases: a null text counts as empty, an empty text has no token and the digests of no bytes;
repeated rows give repeated rows; texts are encoded whole; other columns are left alone, those
named like a result column are replaced. Strings of special tokens inside a text become those tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obscat.llm.arrays import pieces
from obscat.llm.caches import only
from obscat.llm.registry import query, table

#: Letters in a worker's table of encoded pieces, and in its table of encoded words. A full one becomes the
#: older one, from which entries still in use move to the new one, so at most two of this size are held.
TABLE_LETTERS = 2_500_000
BATCH_BYTES = 2 << 20
#: What an entry counts besides its letters.
SMALL_ENTRY = 8
#: Pairs of tokens remembered to stay apart or not.
MOST_PAIRS = 300_000
#: Four control characters that str.split takes for white space and the vocabulary's rules don't.
SPACES_OF_PYTHON_ONLY = re.compile("[\x1c-\x1f]")
SPACES = re.compile(r"[^\S\x1c-\x1f]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


# Letters and numbers (first and last code point) that the `regex` module knows and
# the tokenizers library, which follows Unicode 16, takes for other characters.
LATER_LETTERS = """
0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4
A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A
11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()

# First and last capital that Python's lower() does not know yet, and the first small letter.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Sigma always gets its plain small form: its final form would need the neighbours.
SMALL = {0x03A3: 0x03C3} | {c: small + c - a for a, b, small in LATER_CAPITALS for c in range(a, b + 1)}


def older_classes(pattern: str) -> str:
    """``pattern`` with the classes of letters and numbers cut to Unicode 16."""
    cut = "".join("-".join(f"\\U{int(x, 16):08X}" for x in span.split("-")) for span in LATER_LETTERS)
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(name, f"[{name}--[{cut}]]")
    return f"(?V1){pattern}"


class WordBpe:
    """A lower-casing byte-level BPE whose words end in a suffix, from a ``tokenizers`` file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.end or model["byte_fallback"] or spec["decoder"] is not None:
            raise ValueError("a BPE with an end-of-word suffix and no decoder is needed")
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        names = {i: t for t, i in [*self.vocab.items(), *special.items()]}
        #: Lists by id, which are a tenth of dictionaries of numbers; an id without a token has an empty name.
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(older_classes(split["pattern"]["Regex"])).findall
        self.letters = dict(enumerate(byte_letters()))
        bodies = [t.removesuffix(self.end) for t in self.vocab]
        #: Tokens that end each beginning of a token, the longest first; None until asked for.
        self.inner: dict[str, tuple[int, ...] | None] = {b[:n]: None for b in bodies for n in range(1, len(b) + 1)} | {"": ()}
        self.final: dict[str, tuple[int, ...]] = {}
        #: Letters of every token, without the suffix.
        self.sizes = [len(t.removesuffix(self.end)) for t in self.names]
        #: Merges by 65536 times the left token plus the right one; of every merged token its rank and parts.
        self.pairs = {self.vocab[a] << 16 | self.vocab[b]: i for (a, b), i in self.ranks.items()}
        self.made = {self.vocab[a + b]: (i, self.vocab[a], self.vocab[b]) for (a, b), i in self.ranks.items()}
        if len(self.made) < len(self.ranks):
            raise ValueError("every token must come from one merge")
        #: By 65536 times the left token, or -1, plus the right one.
        self.apart: dict[int, bool] = {}
        if len(self.names) > 1 << 16:
            raise ValueError("pairs of tokens are kept in 32 bits: ids must stay below 65536")
        self.ids = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self.pieces = Table()
        self.done = Table()

    def merged(self, parts: list[str]) -> list[str]:
        """Merge neighbours, always the pair with the lowest rank, the leftmost of equals."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        return [*body] if body == token else [*body[:-1], body[-1] + self.end]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``; ``a`` is -1 at the start of a word."""
        known = self.apart.get(a << 16 | b)
        if known is None:
            right = self.names[b]
            if a < 0:
                known = self.merged(self.symbols(right)) == [right]
            else:
                known = self.stay_apart(-1, a) and self.stay_apart(-1, b) and self.no_merge_between(a, b)
            self.apart[a << 16 | b] = known
        return known

    def no_merge_between(self, a: int, b: int) -> bool:
        """Whether no merge crosses from ``a`` to ``b`` while their own merges, undone here from the last on, are made."""
        pairs, made, base = self.pairs, self.made, (-1, -1, -1)
        limit = len(pairs)
        while True:
            if pairs.get(a << 16 | b, limit) < limit:
                return False
            (x, _, end), (y, start, _) = made.get(a, base), made.get(b, base)
            if x > y:
                limit, a = x, end
            elif y < 0:
                return True
            else:
                # of equal merges the left one, across the boundary, comes first
                limit, b = y + 1, start

    def endings(self, body: str, suffix: str = "") -> tuple[int, ...]:
        """Tokens that end ``body``, the longest first."""
        found = (self.vocab.get(body[i:] + suffix) for i in range(len(body)))
        return tuple([t for t in found if t is not None])

    def last_token(self, ends: tuple[int, ...], n: int, states: list[int]) -> int:
        """State of the prefix of length ``n``, given the tokens that may end it and the states of all shorter ones."""
        apart, sizes = self.apart, self.sizes
        for token in ends:
            before = states[n - sizes[token]]
            known = apart.get(before << 16 | token)
            if known or known is None and self.stay_apart(before, token):
                return token
        raise ValueError("no token ends a prefix")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, depth first over the trie of their letters."""
        out, before, states, firsts = {}, "", [-1], [0]
        inner, final, sizes = self.inner, self.final, self.sizes
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del states[shared + 1 :], firsts[shared + 1 :]
            for n in range(len(states), len(word) + 1):
                first = firsts[-1]
                while (body := word[first:n]) not in inner:
                    first += 1
                if n < len(word):
                    ends = inner[body]
                    if ends is None:
                        ends = inner[body] = self.endings(body)
                    states.append(self.last_token(ends, n, states))
                    firsts.append(first)
            ends = final.get(body)
            if ends is None:
                ends = final[body] = self.endings(body, self.end)
            tokens, n, token = [], len(word), self.last_token(ends, len(word), states)
            while True:
                tokens.append(token)
                n -= sizes[token]
                if n == 0:
                    break
                token = states[n]
            out[word], before = tokens[::-1], word
        return out

    def pretokens(self, text: str) -> list[str | int]:
        """Words of a text as letters of its bytes, and ids of the special tokens in it."""
        parts = self.at_special.split(text) if self.at_special and "<" in text else [text]
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if part.isascii():
                part = part.lower()
                words = [part] if part.isalpha() else self.words(part)
                out.extend(words if part.isprintable() else map(self.as_letters, words))
                continue
            part = unicodedata.normalize("NFC", part).translate(SMALL).lower()
            out.extend(map(self.as_letters, self.words(part)))
        return out

    def as_letters(self, word: str) -> str:
        """A word as letters of its bytes."""
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def learn(self, texts: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of pieces, from the words already encoded and the new ones among theirs."""
        split = {t: [t.lower()] if t.isascii() and t.isalpha() else self.pretokens(t) for t in texts}
        known, new = self.done.find({w for words in split.values() for w in words if isinstance(w, str)})
        fresh = {w: b"".join([self.ids[i] for i in ids]) for w, ids in self.encode_words(new).items()}
        self.done.add(fresh)
        known.update(fresh)
        out = {}
        for text, words in split.items():
            if len(words) == 1 and isinstance(words[0], str):
                out[text] = known[words[0]]
                continue
            out[text] = b"".join([known[w] if isinstance(w, str) else self.ids[w] for w in words])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """``(ids as little-endian 32-bit integers, decoded text)`` of every text."""
        split = [SPACES.split(t) if SPACES_OF_PYTHON_ONLY.search(t) else t.split() for t in texts]
        if len(self.apart) > MOST_PAIRS:
            self.apart.clear()
        asked = set().union(*split)
        asked.discard("")
        known, new = self.pieces.find(asked)
        learned = self.learn(new)
        self.pieces.add(learned)
        known.update(learned)
        known[""] = b""
        packed = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        return [(ids, self.decode(memoryview(ids).cast("I").tolist()) if ids else "") for ids in packed]


class Table:
    """Encoded texts by what was encoded, of bounded size: new ones, and older ones that were not asked for since."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = 0

    def find(self, asked: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """``(entries of those that are there, the others)``."""
        if self.letters > TABLE_LETTERS:
            self.new, self.old, self.letters = {}, self.new, 0
        known = {t: self.new[t] for t in asked.intersection(self.new)}
        again = {t: self.old[t] for t in asked.difference(known).intersection(self.old)}
        self.add(again)
        known.update(again)
        return known, asked.difference(known)

    def add(self, entries: dict[str, bytes]) -> None:
        """Add entries while there is room; the rest is not kept."""
        room = 2 * TABLE_LETTERS - self.letters
        if room <= 0:
            return
        for text, value in entries.items():
            size = len(text) + SMALL_ENTRY
            if size > room:
                continue
            room -= size
            self.new[text] = value
        self.letters = 2 * TABLE_LETTERS - room


def worker_bpe(text: str) -> WordBpe:
    """The tokenizer of this Python worker, with its tables, until a task of another operator comes."""
    return only(f"bpe-{hashlib.sha256(text.encode()).hexdigest()}", lambda: WordBpe(text))


def encode_decode(docs: DataFrame, vocabulary: str, text: str = "text", with_values: bool = False) -> DataFrame:
    """Add ``n_tokens, ids_sha256, decoded_sha256`` to ``docs``; the text is dropped.

    With ``with_values`` the results are ``ids`` (array of int) and ``decoded`` instead.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    values = ["ids", "decoded"] if with_values else ["n_tokens", "ids_sha256", "decoded_sha256"]
    others = [c for c in docs.columns if c != text and c.lower() not in values]
    kinds = "ids array<int>, decoded string" if with_values else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    row = docs.select(F.struct(*[docs[c] for c in others]).alias("kept"), docs[text].cast("string").alias("text"))
    kept = row.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec.value)
        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES):
                found = bpe.encode([t or "" for t in piece.column("text").to_pylist()])
                if with_values:
                    columns = {"ids": pa.array([memoryview(i).cast("I").tolist() if i else [] for i, _ in found], pa.list_(pa.int32())), "decoded": pa.array([d for _, d in found], pa.string())}
                else:
                    columns = {
                        "n_tokens": pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in found], pa.string()),
                    }
                yield pa.RecordBatch.from_arrays([piece.column("kept"), *columns.values()], names=["kept", *columns])

    return row.mapInArrow(run, f"kept {kept}, {kinds}").select("kept.*", *values)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document."""
    return encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
