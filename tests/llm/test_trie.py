"""The prefix trie against a dictionary of prefixes, with many shards and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obscat.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key int, shard string"


def plain_nodes(convs):
    """``{path: columns}`` of every prefix; ``convs`` maps a conversation to its turns."""
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    out = []
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        out.append((
            min(held), len(path), min(members[path[:-1]]) if path else None, len(held), len(children),
            sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(convs):
    return [(c, i, role, text, 7, "x") for c, turns in convs.items() for i, (role, text) in enumerate(turns)]


def found(spark, rows, **kwargs):
    whole, _ = trie.paths(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r) for r in trie.prefix_trie(whole, **kwargs).drop("turn_id").collect()), key=str)


def random_convs(seed, n=40):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé", "ccc", "😀x"]))
    convs = {}
    for c in range(n):
        start = list(convs[rng.randrange(c)]) if c and rng.random() < 0.7 else []
        convs[c * 3] = (start[: rng.randrange(len(start) + 1)] + [turn() for _ in range(rng.randrange(4))]) or [turn()]
        convs = {**convs}
        convs[c] = convs[c * 3]
    return convs


@pytest.mark.parametrize("shard_turns", [1, 7, 30, trie.SHARD_TURNS])
def test_nodes_equal_all_prefixes(spark, shard_turns):
    convs = random_convs(shard_turns)
    rows = rows_of(convs)
    random.Random(1).shuffle(rows)
    assert found(spark, rows, shard_turns=shard_turns) == plain_nodes(convs)


def test_many_partitions_and_a_common_conversation(spark, many_slices):
    convs = random_convs(5, 25) | {i: [("user", "same"), ("assistant", "answer")] for i in range(1000, 1400)}
    assert found(spark, rows_of(convs), shard_turns=50) == plain_nodes(convs)


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    whole = spark.createDataFrame([(1, []), (2, [(5, 3)])], "conv_id long, turns array<struct<turn_id: long, n_chars: long>>")
    nodes = {r.depth: r for r in trie.prefix_trie(whole).collect()}
    assert (nodes[0].n_convs, nodes[0].n_children, nodes[0].n_leaves, nodes[0].conv_id) == (2, 1, 1, 1)
    assert nodes[0].ends_sha256 == hashlib.sha256(b"1").hexdigest()
    assert (nodes[1].n_convs, nodes[1].saved_tokens, nodes[1].parent_conv_id) == (1, 0, 1)


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [
        (1, None, None, "first", 1, "k"), (1, 1, "user", None, 1, "k"), (1, 1, "user", None, 2, "k"),
        (2, None, "", "first", 3, None), (2, 5, "user", "", 4, None), (None, 1, "user", "lost", 5, None),
    ]
    convs = {1: [("", "first"), ("user", ""), ("user", "")], 2: [("", "first"), ("user", "")]}
    assert found(spark, rows) == plain_nodes(convs)


def test_turns_that_differ_only_in_where_the_role_ends(spark):
    convs = {1: [("a", "b:c")], 2: [("a:b", "c")]}
    assert found(spark, rows_of(convs)) == plain_nodes(convs)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_a_very_long_conversation_and_text(spark):
    convs = {1: [("user", "x" * 200_000)] + [("user", str(i % 7)) for i in range(3000)]}
    convs[2] = convs[1][:2500]
    nodes = found(spark, rows_of(convs), shard_turns=100)
    assert len(nodes) == 3002
    root = next(n for n in nodes if n[1] == 0)
    assert root[3:7] == (2, 1, 1, 200_000 + 2499)


def test_the_tree_stays_shallow_where_turns_come_in_order():
    n = 1000
    tree = trie.TernaryTree()
    for k in trie._insertion_order(n):
        tree.insert(np.array([k]), np.array([1]), np.array([k]))

    def height(node):
        return 0 if not node else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.equal[0]) == 10
    assert [tree.turn[i] for i in tree.order()[1:]] == list(range(n))


def test_the_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(9)
    own = {c: [(rng.choice("ua"), rng.choice(["p", "q", "r"])) for _ in range(rng.randrange(1, 8))] for c in [0, 1, 2, 3, 55, 99, 101, 150, 200, 250, 305]}
    spark.createDataFrame(rows_of(own), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    got = sorted((tuple(r) for r in trie.op11_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == plain_nodes(rebuilt)
