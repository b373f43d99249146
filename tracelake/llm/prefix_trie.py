"""Prefix trie of conversations: members, leaves and the tokens that shared prefixes save.

Every conversation is the sequence of its turns (role and text), named by 128-bit digests, so no
text is shuffled. The sequences are range-partitioned by sequence and id into shards of bounded
size; equal sequences may lie in several shards. A shard numbers its distinct turns in order (its
dictionary) and inserts its distinct sequences into a ternary search tree, medians first, which
keeps the search trees below each node balanced. An iterative walk adds up every node's members,
leaves and savings.

Only the nodes on the way to a shard's first and last sequence can also lie in other shards. These
boundary nodes keep what is theirs apart from other boundary nodes and are merged in rounds of
``FAN_IN`` neighbouring shards with the same tree, each leaving the boundary of its block, until one
block is left. So a task holds one shard or the boundaries of ``FAN_IN`` blocks. The ids that end
at a boundary node are hashed in order as a stream of the shards' pieces.

Defined cases: rows with a null conversation id belong to no conversation; a null role or text
counts as empty; turns are ordered by number, null first, rows of one number by the digest of role
and text, repeated rows count as further turns; a table without conversations has no node. A
conversation's digests (16 bytes a turn) lie in one row, its texts do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import partitions, written

#: Bytes of a turn's digest.
WIDTH = 16
#: Conversations of a shard, about.
SHARD_ROWS = 50_000
#: Shards or blocks whose boundaries a task merges.
FAN_IN = 64

_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: ``part`` is 0 for a node that is complete, 1 for a boundary node and 2 for ids that end at one.
_NODE = (
    "part int, shard long, slot long, depth long, key binary, turn binary, size long, conv_id long, parent_id long, "
    "parent_slot long, n_convs long, n_children long, n_leaves long, saved long, ends string, first_id long, ids binary"
)


class TernaryTree:
    """Sequences of integers. Node 0 is the root; children are created after their parents.

    The children of a node form a binary search tree over their symbols: ``below`` is its top,
    ``left`` and ``right`` lead to smaller and larger siblings.
    """

    def __init__(self):
        self.symbol, self.parent, self.depth = [-1], [-1], [0]
        self.below, self.left, self.right = [-1], [-1], [-1]

    def _grow(self, symbol: int, parent: int) -> int:
        self.symbol.append(symbol)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        for links in (self.below, self.left, self.right):
            links.append(-1)
        return len(self.symbol) - 1

    def insert(self, sequence) -> int:
        """The node of the sequence, made where it is missing."""
        node, names = 0, self.symbol
        for symbol in sequence:
            at, links, origin = self.below[node], self.below, node
            while at >= 0 and names[at] != symbol:
                links = self.left if symbol < names[at] else self.right
                origin, at = at, links[at]
            if at < 0:
                at = links[origin] = self._grow(symbol, node)
            node = at
        return node

    def path(self, sequence) -> list[int]:
        """The nodes of a sequence that is in the tree, the root first."""
        nodes = [0]
        for symbol in sequence:
            at = self.below[nodes[-1]]
            while self.symbol[at] != symbol:
                at = (self.left if symbol < self.symbol[at] else self.right)[at]
            nodes.append(at)
        return nodes

    def walk(self) -> list[int]:
        """All nodes, parents before children and siblings in order, without recursion."""
        order, stack = [], [(0, True)]
        while stack:
            node, open_ = stack.pop()
            if not open_:
                order.append(node)
                if self.below[node] >= 0:
                    stack.append((self.below[node], True))
                continue
            if self.right[node] >= 0:
                stack.append((self.right[node], True))
            stack.append((node, False))
            if self.left[node] >= 0:
                stack.append((self.left[node], True))
        return order


def medians(n: int) -> Iterator[int]:
    """``0 .. n - 1``, the middle of every range before its halves."""
    ranges = [(0, n)]
    while ranges:
        low, high = ranges.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            ranges += [(low, middle), (middle + 1, high)]


class Sums:
    """Per node of a tree: what lies in its part of the table, added up from the leaves.

    A boundary node gives nothing to its parent if that is a boundary node, as the root is whenever
    there are boundary nodes: what it holds in other shards is not known yet.
    """

    def __init__(self, tree: TernaryTree):
        n = len(tree.symbol)
        self.tree = tree
        self.n, self.children, self.leaves, self.saved, self.size = ([0] * n for _ in range(5))
        self.least: list[int | None] = [None] * n

    def add(self, node: int, n: int, least: int | None, children: int = 0, leaves: int = 0, saved: int = 0):
        self.n[node] += n
        self.children[node] += children
        self.leaves[node] += leaves
        self.saved[node] += saved
        self._lower(node, least)

    def _lower(self, node: int, least: int | None):
        if least is not None and (self.least[node] is None or least < self.least[node]):
            self.least[node] = least

    def gather(self, boundary: set[int]) -> list[int]:
        order, parent = self.tree.walk(), self.tree.parent
        for node in reversed(order):
            if node in boundary:
                continue
            if not self.children[node]:
                self.leaves[node] = 1
            self.saved[node] += (self.n[node] - 1) * self.size[node]
            up = parent[node]
            if up >= 0:
                self.add(up, self.n[node], self.least[node], 1, self.leaves[node], self.saved[node])
        return order


def _rows(columns: dict[str, list], count: int) -> Iterator[pa.RecordBatch]:
    """Record batches of the node schema; absent columns are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in _NODE.split(", ")]
    arrays = [pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(count, kinds[k]) for c, k in fields]
    yield from pa.Table.from_arrays(arrays, [c for c, _ in fields]).to_batches(max_chunksize=10_000)


def _boundary(ways: list[list[int]]) -> dict[int, int]:
    """Slot of each node on the ways to the first and the last sequence."""
    return {node: 2 * depth + side for side in (1, 0) for depth, node in enumerate(ways[side])}


def _nodes(sums: Sums, order: list[int], slots: dict[int, int], shard: int, names: list[bytes], keys, ends=None):
    """Rows of all nodes: complete ones with their parent's id or slot, boundary ones as they are."""
    tree, out = sums.tree, {c: [] for c in (
        "part", "shard", "slot", "depth", "key", "turn", "size", "conv_id", "parent_id", "parent_slot", "n_convs",
        "n_children", "n_leaves", "saved", "ends",
    )}
    for node in order:
        up, slot = tree.parent[node], slots.get(node)
        up_slot = slots.get(up)
        for c, v in (
            ("part", 0 if slot is None else 1),
            ("shard", shard),
            ("slot", slot),
            ("depth", tree.depth[node]),
            ("key", keys.get(node)),
            ("turn", names[tree.symbol[node]] if up >= 0 else b""),
            ("size", sums.size[node]),
            ("conv_id", sums.least[node]),
            ("parent_id", sums.least[up] if up >= 0 and up_slot is None else None),
            ("parent_slot", up_slot),
            ("n_convs", sums.n[node]),
            ("n_children", sums.children[node]),
            ("n_leaves", sums.leaves[node]),
            ("saved", sums.saved[node]),
            ("ends", ends.get(node, _NO_ENDS) if ends is not None and slot is None else None),
        ):
            out[c].append(v)
    return _rows(out, len(order))


def _keys(raw: bytes, way: list[int]) -> dict[int, bytes]:
    """A name for each node of a way that is the same in every shard."""
    seen, out = hashlib.sha256(), {way[0]: hashlib.sha256().digest()}
    for k, node in enumerate(way[1:]):
        seen.update(raw[k * WIDTH : (k + 1) * WIDTH])
        out[node] = seen.digest()
    return out


def _shard(batches):
    """The nodes of one shard, whose rows come sorted by sequence and id."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    shard = TaskContext.get().partitionId()
    ids = np.asarray(table.column("conv_id"))
    paths, sizes = table.column("path").combine_chunks(), table.column("sizes").combine_chunks()
    raw = [p.as_py() for p in paths]
    fresh = [0, *(k for k in range(1, len(raw)) if raw[k] != raw[k - 1]), len(raw)]
    distinct = [raw[k] for k in fresh[:-1]]
    # The dictionary: turns numbered in the order of their digests, so numbers sort like sequences.
    turns = np.frombuffer(b"".join([*distinct, bytes(WIDTH)]), np.dtype((np.void, WIDTH)))[:-1]
    names, numbers = np.unique(turns, return_inverse=True)
    names, numbers = [bytes(x) for x in names], numbers.tolist()
    bounds = [0, *accumulate(len(p) // WIDTH for p in distinct)]
    tree, at = TernaryTree(), [0] * len(distinct)
    for k in medians(len(distinct)):
        at[k] = tree.insert(numbers[bounds[k] : bounds[k + 1]])
    sums = Sums(tree)
    for k, node in enumerate(at):
        sums.add(node, fresh[k + 1] - fresh[k], int(ids[fresh[k]]))
    for k, node in enumerate(at):
        known = sizes[fresh[k]].as_py()
        while node and not sums.size[node]:
            sums.size[node] = known[tree.depth[node] - 1]
            node = tree.parent[node]
    ways = [tree.path(numbers[bounds[k] : bounds[k + 1]]) for k in (0, len(distinct) - 1)]
    slots = _boundary(ways)
    order = sums.gather(set(slots))
    keys = _keys(distinct[-1], ways[1]) | _keys(distinct[0], ways[0])
    ends, pieces = {}, {c: [] for c in ("part", "key", "first_id", "ids")}
    for k, node in enumerate(at):
        text = ",".join(map(str, ids[fresh[k] : fresh[k + 1]].tolist())).encode()
        if node not in slots:
            ends[node] = hashlib.sha256(text).hexdigest()
            continue
        for c, v in (("part", 2), ("key", keys[node]), ("first_id", int(ids[fresh[k]])), ("ids", text)):
            pieces[c].append(v)
    yield from _nodes(sums, order, slots, shard, names, keys, ends)
    yield from _rows(pieces, len(pieces["part"]))


def _merge(last: bool, fan_in: int):
    """Merge the boundary nodes of neighbouring blocks into those of one block."""

    def run(key, table):
        rows = table.sort_by([("shard", "ascending"), ("depth", "ascending")]).to_pylist()
        names = sorted({r["turn"] for r in rows if r["depth"]})
        number = {name: k for k, name in enumerate(names)}
        ways: dict[tuple[int, int], list[dict]] = {}
        for r in rows:
            ways.setdefault((r["shard"], r["slot"] % 2), []).append(r)
        chains = []
        for shard in sorted({r["shard"] for r in rows}):
            first, own = ways[shard, 0], ways.get((shard, 1), [])
            # A node on both ways has the slot of the first; the last way shares its beginning.
            shared = own[0]["depth"] if own else len(first)
            chains.append(first)
            chains.append(first[:shared] + own if own else first)
        sequences = [[number[r["turn"]] for r in chain[1:]] for chain in chains]
        tree = TernaryTree()
        for k in medians(len(sequences)):
            tree.insert(sequences[k])
        sums, keys, seen = Sums(tree), {}, set()
        for chain, sequence in zip(chains, sequences):
            for r, node in zip(chain, tree.path(sequence)):
                if (r["shard"], r["slot"]) in seen:
                    continue
                seen.add((r["shard"], r["slot"]))
                keys[node], sums.size[node] = r["key"], r["size"]
                sums.add(node, r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved"])
        slots = {} if last else _boundary([tree.path(sequences[0]), tree.path(sequences[-1])])
        order = sums.gather(set(slots))
        block = rows[0]["shard"] // fan_in
        return pa.Table.from_batches(list(_nodes(sums, order, slots, block, names, keys)))

    return run


def _hash_ends(batches):
    """SHA-256 of each key's pieces, which come sorted by their first id."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids)
            else:
                state.update(b",")
                state.update(ids)
        yield _ended(done)
    if key is not None:
        yield _ended([(key, state.hexdigest())])


def _ended(done) -> pa.RecordBatch:
    arrays = [pa.array([k for k, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["key", "ended"])


def sequences(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``conv_id, turns``: every conversation's turns in order, as digests and byte lengths of texts."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(named.cast("binary"), 256)), 1, WIDTH)
    rows = turns.filter(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("size")
        ).alias("one"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return rows.withColumn("turns", plain)


def graft(convs: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Replace the first ``head`` turns of each conversation by those of the conversation ``base``.

    ``most`` bounds ``head``; of the other conversation all turns count if it has fewer, none if it
    is absent.
    """
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("heads"))
    rows = convs.withColumn("head", head).withColumn("base", base).join(heads, "base", "left")
    # Kept as an expression: lengths of slices differ from row to row.
    front = F.expr("slice(coalesce(heads, array()), 1, cast(head AS int))")
    back = F.expr("slice(turns, cast(head AS int) + 1, size(turns))")
    return rows.select("conv_id", F.concat(front, back).alias("turns"))


def trie(convs: DataFrame, shard_rows: int = SHARD_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node of the trie of ``convs`` (``conv_id, turns``)."""
    rows = convs.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )
    rows = written(rows, "conversations")
    shards = max(partitions(rows), -(-rows.count() // shard_rows))
    dealt = rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = written(dealt.mapInArrow(_shard, _NODE), "shards")
    done, edges = [found.filter("part = 0")], found.filter("part = 1")
    layers = [edges.select("shard", "slot", "key")]
    width = (edges.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        width = -(-width // fan_in)
        blocks = edges.withColumn("block", F.floor(F.col("shard") / fan_in))
        merged = written(blocks.groupBy("block").applyInArrow(_merge(width == 1, fan_in), _NODE), "boundaries")
        done.append(merged.filter("part = 0"))
        if width == 1:
            break
        edges = merged.filter("part = 1")
        layers.append(edges.select("shard", "slot", "key"))
    return _finish(found, done, layers)


def _finish(found: DataFrame, done: list[DataFrame], layers: list[DataFrame]) -> DataFrame:
    """Complete nodes with the ids of parents that were completed in later rounds and their ends."""
    # Boundary nodes are a few per shard; every one is completed in exactly one round.
    owners = reduce(DataFrame.union, done[1:]).select("key", F.col("conv_id").alias("owner"))
    nodes = []
    for layer, rows in enumerate(done):
        nodes.append(rows.filter("parent_slot IS NULL").select(*_KEPT))
        if layer < len(layers):
            slots = layers[layer].join(owners, "key").select("shard", F.col("slot").alias("parent_slot"), "owner")
            found_parents = rows.drop("parent_id").join(slots, ["shard", "parent_slot"])
            nodes.append(found_parents.withColumnRenamed("owner", "parent_id").select(*_KEPT))
    nodes = reduce(DataFrame.union, nodes)
    pieces = found.filter("part = 2").select("key", "first_id", "ids")
    pieces = pieces.repartition(partitions(found), "key").sortWithinPartitions("key", "first_id")
    ended = pieces.mapInArrow(_hash_ends, "key binary, ended string")
    inner, outer = nodes.filter("ends IS NOT NULL"), nodes.filter("ends IS NULL")
    outer = outer.join(ended, "key", "left").withColumn("ends", F.coalesce("ended", F.lit(_NO_ENDS)))
    columns = ["conv_id", "depth", F.col("parent_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens")]
    columns.append(F.col("ends").alias("ends_sha256"))
    return inner.select(*columns).union(outer.select(*columns))


_KEPT = ("key", "conv_id", "depth", "parent_id", "n_convs", "n_children", "n_leaves", "saved", "ends")
