"""Prefix trie of conversations: who shares which first turns, and what sharing them saves.

Every distinct turn (role, text) gets a number from a dictionary, so a conversation is a path of
numbers. Paths are range-partitioned in their order and a task cuts its range into shards of at most
``SHARD_TURNS`` numbers (or one path). A shard holds its paths in a ternary search tree: the turns that
may follow a prefix are a binary search tree, balanced because the median path of every stretch goes
in first. One iterative traversal adds up members, leaves and savings from the ends to the root.

Only prefixes of a shard's first and last path can reach into another shard. These boundary nodes
are merged by a 128-bit digest of their path: members and children are added up by key, and what lies
below a node is summed inside each shard and then over shards, so neither the root nor a turn that
a third of all conversations share meets in one task. Of a node where many paths end, a task puts the
members' numbers together to pieces, and the node's digest is taken over its pieces in order.

Cases: a null role or text is empty; rows without a conversation number belong to no conversation and
are left out; turns are ordered by number, null first, equal numbers by the digest of role and text, and
repeated rows are turns as often as they stand there; a conversation without turns is a member of the root; an
empty table has no nodes. The turn numbers of one conversation (16 bytes each) must fit a task, its texts need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obscat.llm.registry import query, table
from obscat.llm.store import written

#: Turn numbers that a shard holds, if it has more than one path.
SHARD_TURNS = 1 << 17
#: Members' numbers in a piece of the text that a node's digest is taken of.
PIECE_MEMBERS = 1 << 12

_NODES = pa.schema([
    ("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("shard", pa.int64()), ("at", pa.int64()),
    ("branch", pa.string()), ("turn_id", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("last_chars", pa.int64()), ("ends", pa.string()), ("ends_sha256", pa.string()),
])
_NODES_SQL = (
    "kind string, key binary, parent_key binary, shard long, at long, branch string, turn_id long, conv_id long, depth long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, last_chars long, ends string, ends_sha256 string"
)


# Turns to paths

def turn_dictionary(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns, dictionary)``: rows as (conv_id, turn, digest, n_chars), and a number for every digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.unhex(F.sha2(F.concat_ws(":", F.char_length(role), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("n_chars"),
    )
    numbered = turns.select("digest").distinct().withColumn("turn_id", F.monotonically_increasing_id())
    return turns, written(numbered, "trie-dictionary")


def paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(paths, dictionary)``: per conversation its turns in order, an array of (turn_id, n_chars).

    Rows are put in order by range, so a conversation of many rows is cut between tasks, and its
    stretches meet as one row each.
    """
    turns, dictionary = turn_dictionary(conversations)
    rows = turns.join(dictionary, "digest").repartitionByRange("conv_id", "turn", "digest")
    inside = F.sort_array(F.collect_list(F.struct("turn", "digest", "turn_id", "n_chars")))
    stretches = rows.withColumn("_slice", F.spark_partition_id()).groupBy("conv_id", "_slice").agg(inside.alias("_turns"))
    plain = F.transform("_turns", lambda t: F.struct(t["turn_id"].alias("turn_id"), t["n_chars"].alias("n_chars")))
    stretches = stretches.select("conv_id", F.struct("_slice", plain.alias("turns")).alias("_part"))
    ordered = F.sort_array(F.collect_list("_part"))
    whole = stretches.groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda p: p["turns"])).alias("turns"))
    return written(whole, "trie-conversations"), dictionary


def with_shared_beginning(whole: DataFrame, origin: Column, taken: Column, most: int) -> DataFrame:
    """Replace the first ``taken`` turns (at most ``most``) of every conversation by those of ``origin``."""
    lent = whole.select(F.col("conv_id").alias("_origin"), F.slice("turns", 1, most).alias("_lent"))
    asking = whole.withColumn("_origin", origin).withColumn("_h", taken.cast("int"))
    lent_turns = F.slice(F.coalesce("_lent", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    own = F.expr("slice(turns, _h + 1, greatest(size(turns) - _h, 0))")
    return asking.join(lent, "_origin", "left").select("conv_id", F.concat(lent_turns, own).alias("turns"))


# One shard

class TernaryTree:
    """Ternary search tree over paths of turn numbers; node 0 is the root, without a turn.

    ``low`` and ``high`` lead to siblings with smaller and larger turns, ``equal`` to the turns that may follow.
    """

    def __init__(self):
        self.turn, self.low, self.high, self.equal = [-1], [0], [0], [0]
        self.parent, self.depth, self.chars, self.ending = [-1], [0], [0], [None]

    def _new(self, turn: int, chars: int, parent: int) -> int:
        for column, value in (
            (self.turn, turn), (self.low, 0), (self.high, 0), (self.equal, 0), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.chars, chars), (self.ending, None),
        ):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, path: np.ndarray, chars: np.ndarray, members: np.ndarray) -> None:
        """Add a path with its members, in ascending order."""
        turns, low, high, equal = self.turn, self.low, self.high, self.equal
        node = 0
        for turn, size in zip(path.tolist(), chars.tolist()):
            links, at = equal, node
            child = equal[node]
            while child and turns[child] != turn:
                links, at = (low, child) if turn < turns[child] else (high, child)
                child = links[at]
            if not child:
                child = self._new(turn, size, node)
                links[at] = child
            node = child
        self.ending[node] = members

    def order(self) -> list[int]:
        """Nodes in the order of their paths, a prefix before what follows it."""
        out, stack = [], [0]
        while stack:
            node = stack.pop()
            if node < 0:
                out.append(~node)
                if self.equal[~node]:
                    stack.append(self.equal[~node])
                continue
            if self.high[node]:
                stack.append(self.high[node])
            stack.append(~node)
            if self.low[node]:
                stack.append(self.low[node])
        return out


def _insertion_order(n: int) -> Iterator[int]:
    """0 to n-1, the median of every stretch before its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += [(middle + 1, high), (low, middle)]


def _ends(members: np.ndarray | None) -> str:
    return "" if members is None else ",".join(map(str, members.tolist()))


def shard_nodes(shard: int, ids: list[np.ndarray], chars: list[np.ndarray], convs: np.ndarray) -> dict[str, list]:
    """Nodes of one shard from its paths in order; columns as in ``_NODES``."""
    first_of = [0] + [i for i in range(1, len(ids)) if not np.array_equal(ids[i], ids[i - 1])] + [len(ids)]
    tree = TernaryTree()
    for k in _insertion_order(len(first_of) - 1):
        a, b = first_of[k], first_of[k + 1]
        tree.insert(ids[a], chars[a], convs[a:b])
    order = tree.order()
    n = len(order)
    boundary: dict[int, bytes] = {}
    for path in (ids[0], ids[-1]):  # the first and the last path, and their digests
        node, digest = 0, hashlib.blake2b(digest_size=16)
        boundary[0] = digest.digest()
        for turn in path.tolist():
            child = tree.equal[node]
            while tree.turn[child] != turn:
                child = tree.low[child] if turn < tree.turn[child] else tree.high[child]
            node = child
            digest.update(turn.to_bytes(8, "little"))
            boundary[node] = digest.digest()
    members, smallest = [0] * n, [None] * n
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for node in reversed(order):
        ending = tree.ending[node]
        if ending is not None:
            members[node] += len(ending)
            least = int(ending[0])
            smallest[node] = least if smallest[node] is None else min(smallest[node], least)
        if node not in boundary:
            leaves[node] += children[node] == 0
            saved[node] += (members[node] - 1) * tree.chars[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            smallest[up] = smallest[node] if smallest[up] is None else min(smallest[up], smallest[node])
            if node not in boundary:
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
    last = set()
    node = 0
    for turn in ids[-1].tolist():
        child = tree.equal[node]
        while tree.turn[child] != turn:
            child = tree.low[child] if turn < tree.turn[child] else tree.high[child]
        node = child
        last.add(node)
    out: dict[str, list] = {name: [] for name in _NODES.names}

    def row(**values) -> None:
        for name, column in out.items():
            column.append(values.get(name))

    for at, node in enumerate(order):
        up, key = tree.parent[node], boundary.get(node)
        same = dict(
            shard=shard, turn_id=None if node == 0 else tree.turn[node], conv_id=smallest[node], depth=tree.depth[node],
            n_convs=members[node], n_children=children[node], n_leaves=leaves[node], saved_tokens=saved[node],
            last_chars=tree.chars[node], parent_key=boundary.get(up),
        )
        if key is None:
            text = _ends(tree.ending[node])
            row(kind="inner", parent_conv_id=smallest[up], ends_sha256=hashlib.sha256(text.encode()).hexdigest(), **same)
            continue
        row(kind="boundary", key=key, at=at, branch="rest" if node in last or node == 0 else "first", **same)
        ending = tree.ending[node]
        for a in range(0, 0 if ending is None else len(ending), PIECE_MEMBERS):
            row(kind="ends", key=key, shard=shard, at=a, ends=_ends(ending[a : a + PIECE_MEMBERS]))
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Cut the sorted paths of a partition into shards and give out their nodes."""
    ids: list[np.ndarray] = []
    chars: list[np.ndarray] = []
    convs: list[int] = []
    held, number, part = 0, 0, 0

    def flush():
        nonlocal held, number
        found = shard_nodes((part << 32) + number, ids, chars, np.array(convs, np.int64))
        number, held = number + 1, 0
        ids.clear(), chars.clear(), convs.clear()
        nodes = pa.RecordBatch.from_pydict(found, _NODES)
        for a in range(0, nodes.num_rows, 1 << 14):
            yield nodes.slice(a, 1 << 14)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {}
        for name in ("ids", "chars"):
            column = batch.column(name)
            offsets = column.offsets.to_numpy()
            columns[name] = np.split(column.values.to_numpy()[: offsets[-1]], offsets[1:-1])
            columns[name][0] = columns[name][0][offsets[0] :]
        for i, (conv, number_of) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("part").to_pylist())):
            path = columns["ids"][i]
            if ids and held + len(path) + 1 > shard_turns:
                yield from flush()
            part = number_of
            ids.append(path)
            chars.append(columns["chars"][i])
            convs.append(conv)
            held += len(path) + 1
    if ids:
        yield from flush()


# Merging what shards share

def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 over the pieces of every key, which come in order."""
    key, digest = None, None
    out: list[tuple[bytes, str]] = []
    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b",")
                digest.update(text.encode())
        if out:
            yield pa.RecordBatch.from_pydict({"key": [x[0] for x in out], "ends_sha256": [x[1] for x in out]})
            out = []
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [digest.hexdigest()]})


def _merged(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, by shard)``: boundary nodes over all shards, and the smallest member of each for the shards that hold it."""
    parts = nodes.where("kind = 'boundary'")
    once = parts.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("turn_id").alias("turn_id"), F.first("depth").alias("depth"),
        F.first("last_chars").alias("last_chars"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("_inner_children"), F.min("shard").alias("_owner"),
    )
    below = once.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_merged_children"))
    once = once.join(below, "key", "left").withColumn("n_children", F.col("_inner_children") + F.coalesce("_merged_children", F.lit(0)))
    once = written(once.select(
        "key", "parent_key", "turn_id", "depth", "conv_id", "n_convs", "n_children", "_owner",
        (F.col("n_children") == 0).cast("long").alias("_leaf"), ((F.col("n_convs") - 1) * F.col("last_chars")).alias("_saved"),
    ), "trie-boundary")
    held = parts.select("key", "shard", "at", "branch", "n_leaves", "saved_tokens").join(
        once.select("key", "_owner", "_leaf", "_saved", F.col("conv_id").alias("_smallest")), "key")
    mine = F.col("_owner") == F.col("shard")
    # what a shard holds below a node: its own inner nodes, and the merged nodes that count for this shard
    held = held.withColumn("_l", F.when(mine, F.col("_leaf")).otherwise(0)).withColumn("_s", F.when(mine, F.col("_saved")).otherwise(0))
    shard = Window.partitionBy("shard")
    down = shard.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("branch") == "rest"

    def below_here(own: str, inner: str) -> Column:
        value = F.col(own) + F.col(inner)
        # a node of the first path alone has no nodes of the last path below it; they follow it in the order
        beside = F.sum(F.when(rest & (F.col("at") > F.col("_turning")), value).otherwise(0)).over(shard)
        return F.sum(value).over(down) - F.when(rest, 0).otherwise(beside)

    turning = F.coalesce(F.min(F.when(~rest, F.col("at"))).over(shard), F.lit(0))
    held = held.withColumn("_turning", turning)
    sums = held.select("key", "shard", "_smallest", below_here("_l", "n_leaves").alias("n_leaves"), below_here("_s", "saved_tokens").alias("saved_tokens"))
    by_shard = written(sums, "trie-shard-sums")
    totals = by_shard.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    pieces = nodes.where("kind = 'ends'").select("key", "shard", "at", "ends")
    ends = pieces.repartition("key").sortWithinPartitions("key", "shard", "at").mapInArrow(_hash_pieces, "key binary, ends_sha256 string")
    parents = once.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    out = once.join(totals, "key").join(parents, "parent_key", "left").join(ends, "key", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), by_shard.select("key", "shard", "_smallest")


OUT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id")


def prefix_trie(whole: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie over ``(conv_id, turns)``, as :func:`paths` gives them, one row per node.

    ``turn_id`` is the dictionary's number of the node's last turn, null at the root; it is turn ``depth``
    of conversation ``conv_id``. ``shard_turns`` bounds a shard and changes no result.
    """
    rows = whole.select("conv_id", F.transform("turns", lambda t: t["turn_id"]).alias("ids"), F.transform("turns", lambda t: t["n_chars"]).alias("chars"))
    ranged = rows.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    nodes = written(ranged.mapInArrow(partial(_shards, shard_turns=shard_turns), _NODES_SQL), "trie-nodes", partition_by="kind")
    boundary, by_shard = _merged(nodes)
    inner = nodes.where("kind = 'inner'")
    below = by_shard.select(F.col("key").alias("parent_key"), "shard", "_smallest")
    inner = inner.join(below, ["parent_key", "shard"], "left").withColumn("parent_conv_id", F.coalesce("_smallest", "parent_conv_id"))
    return inner.select(*OUT).unionByName(boundary.select(*OUT))


#: Fixed values of the contract: conversations share their beginning with the first of their hundred, of fewer than six turns.
HUNDRED, SHARED = 100, 6

ORACLE = f"""
WITH RECURSIVE t AS (SELECT c, digest, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos FROM (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, length(coalesce(text, '')) AS chars,
    sha256(concat_ws(':', length(coalesce(role, '')), coalesce(role, ''), coalesce(text, ''))) AS digest FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS digits FROM t),
crc AS (
  SELECT c, digits, 0 AS bit, xor(4294967295::UBIGINT, ascii(digits)::UBIGINT) AS r FROM convs
  UNION ALL
  SELECT c, digits, bit + 1, CASE WHEN bit % 8 = 7 AND bit // 8 + 1 < length(digits) THEN xor(shifted, ascii(substr(digits, bit // 8 + 2, 1))::UBIGINT) ELSE shifted END
  FROM (SELECT *, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END AS shifted FROM crc WHERE bit < 8 * length(digits))),
taken AS (SELECT c, xor(r, 4294967295::UBIGINT) % {SHARED} AS h FROM crc WHERE bit = 8 * length(digits)),
built AS (SELECT c, digest, chars, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS pos FROM (
  SELECT k.c, false AS own, t.* EXCLUDE (c) FROM taken k JOIN t ON t.c = k.c - k.c % {HUNDRED} AND t.pos <= k.h
  UNION ALL SELECT k.c, true, t.* EXCLUDE (c) FROM taken k JOIN t ON t.c = k.c AND t.pos > k.h)),
held AS (SELECT c, pos AS depth, chars, string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos) AS key FROM built UNION ALL SELECT c, 0, 0, '' FROM convs),
links AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY c) AS is_end FROM held),
nodes AS (SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256 FROM links GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.key AS top, b.key FROM held a JOIN held b ON a.c = b.c AND b.depth >= a.depth),
sums AS (SELECT top AS key, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM below JOIN nodes n USING (key) LEFT JOIN children k USING (key) GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (key) LEFT JOIN children k USING (key) LEFT JOIN nodes p ON p.key = n.parent
"""


@query("op11_trie", ORACLE)
def op11_trie(spark, sf_dir):
    whole, _ = paths(table(spark, sf_dir, "conversations"))
    origin = F.col("conv_id") - F.col("conv_id") % HUNDRED
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    rebuilt = written(with_shared_beginning(whole, origin, taken, SHARED - 1), "trie-rebuilt")
    return prefix_trie(rebuilt).drop("turn_id")
