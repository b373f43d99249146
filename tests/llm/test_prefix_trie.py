"""Tries against a plain one made of dictionaries, with shards of a few rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, key int"


def named(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), len(text.encode())


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, *named(role, text)))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def plain(convs):
    members, ends, size = defaultdict(list), defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            node = tuple(t[0] for t in turns[:d])
            members[node].append(c)
            size[node] = turns[d - 1][1] if d else 0
        ends[node].append(c)
    rows = []
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = {n: sum(len(m) == len(n) + 1 for m in below[n]) for n in members}
    for node, ids in members.items():
        ended = ",".join(map(str, sorted(ends[node]))) if node in ends else ""
        rows.append((
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node],
            sum(children[m] == 0 for m in below[node]), sum((len(members[m]) - 1) * size[m] for m in below[node]),
            hashlib.sha256(ended.encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def build(df, **limits):
    convs = prefix_trie.sequences(df)
    base, head = F.col("conv_id") - F.col("conv_id") % 5, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    rows = prefix_trie.trie(prefix_trie.graft(convs, base, head, 8), **limits)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert rows.columns == names
    return sorted((tuple(r) for r in rows.collect()), key=str)


def random_rows(seed, convs):
    """Few different turns, so prefixes and whole conversations repeat; one opening is in most."""
    rng, rows = random.Random(seed), []
    for c in range(-6, convs):
        turns = rng.choice([1, 2, 3, 3, 12])
        for t in range(turns):
            text = "hello" if not t and rng.random() < 0.7 else rng.choice(["a", "bb", "é", "", None, "x" * 50])
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "bot", None, ""]), text, "p", t))
    same = [(c, t, "user", f"copy {t}", "p", 1) for c in range(convs, convs + 60) for t in range(9)]
    rows += same + same[:3] + [(None, 1, "user", "lost", "p", 0), (10_007, 0, "u", "only", "p", 0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows, fan_in", [(5, 2), (9, 3), (50_000, 64)])
def test_equals_plain_trie(spark, shard_rows, fan_in):
    """Node by node, however many shards share a node and however many rounds merge them."""
    rows = random_rows(shard_rows, 90)
    got = build(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows, fan_in=fan_in)
    assert got == plain(rebuilt(rows))


def test_long_conversation_and_deep_copies(spark):
    rows = [(c, t, "user", f"t{t}", "p", t) for c in (5, 10, 15) for t in range(1_500)]
    rows += [(5, 1_500, "user", "é" * 200_000, "p", 0)]
    convs = prefix_trie.sequences(spark.createDataFrame(rows, SCHEMA))
    got = prefix_trie.trie(convs, shard_rows=1).agg(
        F.count("*"), F.max("depth"), F.max("n_leaves"), F.max("saved_tokens"), F.max("n_convs")
    ).first()
    size = sum(2 * len(f"t{t}") for t in range(1_500))
    assert tuple(got) == (1_502, 1_501, 1, size, 3)


def test_no_conversation(spark):
    lost = [(None, 1, "user", "x", "p", 0)]
    assert build(spark.createDataFrame(lost, SCHEMA)) == []
    assert build(spark.createDataFrame([], SCHEMA)) == []


def test_tree_is_balanced_and_in_order():
    tree = prefix_trie.TernaryTree()
    for k in prefix_trie.medians(1_000):
        tree.insert([k])
    height = {-1: 0}
    for node in range(1_000, 0, -1):
        height[node] = 1 + max(height[tree.left[node]], height[tree.right[node]])
    assert height[tree.below[0]] == 10
    assert [tree.symbol[n] for n in tree.walk()] == [-1, *range(1_000)]
