"""Connected components of a distributed edge table, and of a block within one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import partitions, written


#: Edges that a task contracts at once.
EDGE_ROWS = 1 << 18


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest row of the component of each of ``n`` rows, by edges between row numbers."""
    parent = np.arange(n)
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return parent


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``a > b`` that connect what ``edges`` connects: a star for each component of a part of a task's rows."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            ends = pa.Table.from_batches([batch]).drop_null()
            held.append(np.array([np.asarray(ends.column(c)) for c in ("a", "b")], np.int64))
            rows += len(ends)
            if rows >= EDGE_ROWS:
                yield stars(held)
                held, rows = [], 0
        if rows:
            yield stars(held)

    def stars(held):
        ids, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        least = smallest(*at.reshape(2, -1), len(ids))
        apart = least != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(ids[least[apart]])], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def linked_to_smallest(edges: DataFrame) -> DataFrame:
    """Two star operations on contracted edges ``a > b``.

    Larger neighbours of a node are linked to the smallest of it and its neighbours, then a node's
    smaller neighbours to the smallest of them. A node has at most one smaller neighbour for each part
    that was contracted; a hub has many larger ones, which are only joined, and by a key that Spark splits.
    """
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
    large = edges.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b"))
    small = large.groupBy("a").agg(F.collect_set("b").alias("ends")).withColumn("b", F.array_min("ends"))
    return small.select(F.explode(F.concat(F.array("a"), "ends")).alias("a"), "b").filter("a <> b")


def settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none, or only larger ones."""
    ends = edges.select(F.col("a").alias("id"), "b").union(edges.select("b", F.lit(None).cast("long")))
    nodes = ends.groupBy("id").agg(
        F.min("b").alias("low"), F.max("b").alias("high"), F.max(F.col("b").isNull()).alias("above")
    )
    return not nodes.agg(F.max(F.expr("low < high OR low IS NOT NULL AND above"))).first()[0]


def connected(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id) of every end of ``edges(a, b)``; null ends are left out.

    Edges are written, and tasks that read them back, a few files each, contract what they hold (apart from the tasks that
    found them, so that these have one Python worker each). What tasks do not see alike is joined by two star
    operations a round, until all components are stars around their smallest ids. Every round is written to the
    shared folder; the rounds grow with the logarithm of the longest path that is left.
    """
    pairs = edges.select("a", "b").filter("a <> b")
    pairs = written(contracted(written(pairs, "edges")), "edges")
    while not settled(pairs):
        pairs = written(contracted(written(linked_to_smallest(pairs), "edges")), "edges")
    found = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(found.select("component", "component")).distinct()


class Forest:
    """Union-find over the rows of a block; remembers the edges that joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra == rb:
            return False
        self.parent[max(ra, rb)] = min(ra, rb)
        self.edges.append((a, b))
        return True

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.parent[x]
        while (self.parent[found] != found).any():
            found = self.parent[found]
        return found

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs; those whose ends are joined already take no step of their own."""
        while len(a):
            root = self.roots(a)
            apart = root != self.roots(b)
            a, b, root = a[apart], b[apart], root[apart]
            one = np.unique(root, return_index=True)[1]
            for x, y in zip(a[one].tolist(), b[one].tolist()):
                self.join(x, y)


def _own(size: int) -> tuple[Column, Column]:
    """Number of blocks of a row's key, and the row's own block."""
    count = F.ceil(F.col("n") / size).cast("int")
    return count, F.pmod(F.xxhash64("id", F.lit(7)), count.cast("long")).cast("int")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(partitions(rows), key, "block").sortWithinPartitions(key, "block")


def blocks(members: DataFrame, key: str, size: int) -> DataFrame:
    """Pairs of blocks in which every two rows of a key meet, dealt out and sorted.

    ``members`` has ``id``, the key and ``n``, the key's rows. Rows of a key are dealt by hash to
    blocks of about ``size``; every row gets a copy for each pair of blocks that holds its own.
    Adds ``block`` (number of the pair) and ``side`` (1 or 2; 0 for a block with itself). Each ``key, block`` lies in one partition, its rows in a run.
    """
    count, own = _own(size)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.withColumn("block", low * count + high).withColumn(
        "side", F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0)
    )
    return _dealt(dealt.drop("own", "other", "n"), key)


def _with_first(members: DataFrame, key: str, size: int) -> DataFrame:
    """Every block of a key by itself, beside a copy of the key's first block."""
    count, own = _own(size)
    dealt = members.withColumn("own", own)
    where = F.when(F.col("own") == 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array("own"))
    return _dealt(dealt.withColumn("block", F.explode(where)).withColumn("side", F.lit(0)).drop("own", "n"), key)


def _with_others(members: DataFrame, found: DataFrame, key: str, size: int) -> DataFrame:
    """Rows outside a key's largest component, in blocks, against all its other rows.

    Rows of the largest component are copied once for each block of the others (not at all if there
    are none), the others once for each block of the key.
    """
    kind = F.coalesce("component", "id")
    rows = members.join(found, "id", "left").withColumn("component", kind)
    sizes = rows.groupBy(key, "component").agg(F.count("*").alias("rows"))
    sizes = sizes.groupBy(key).agg(F.max(F.struct("rows", "component")).alias("main"), F.sum("rows").alias("all"))
    sizes = sizes.select(key, F.col("main.component").alias("main"), (F.col("all") - F.col("main.rows")).alias("others"))
    rows = rows.join(sizes.filter("others > 0"), key)
    count, own = _own(size)
    other_count = F.ceil(F.col("others") / size).cast("int")
    other = F.pmod(F.xxhash64("id", F.lit(11)), other_count.cast("long")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.when(F.col("component") != F.col("main"), other))
    # A block is one of the others (left) with one of the key (right); an outsider stands on both sides.
    right = F.transform(F.sequence(F.lit(0), other_count - 1), lambda o: F.struct((o * count + F.col("own")).alias("block"), F.lit(2).alias("side")))
    left = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((F.col("other") * count + k).alias("block"), F.lit(1).alias("side")))
    copies = F.when(F.col("other").isNull(), right).otherwise(F.concat(left, right))
    names = [c for c in members.columns if c != "n"]
    return _dealt(rows.withColumn("copy", F.explode(copies)).select(*names, "copy.*"), key)


def trees(
    members: DataFrame, sizes: DataFrame, key: str, size: int, linked: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Edges that connect the rows of each key as all of its links would.

    ``members`` has ``id``, the key, ``n`` (rows of the key) and what ``linked`` reads; ``sizes`` (written)
    has ``n`` of each key. ``linked`` takes blocks and returns trees ``a, b`` of the links in them. A key of up to
    ``size`` rows is one block. In a larger one every row first meets its block and the key's first
    block; then only rows outside the key's largest component meet all others. A group of near
    copies so costs in proportion to its rows, and no link between two components is left untried.
    """
    edges = linked(blocks(members.filter(F.col("n") <= size), key, size))
    if sizes.filter(F.col("n") > size).isEmpty():
        return edges
    large = written(members.filter(F.col("n") > size), "large")
    edges = written(edges.union(linked(_with_first(large, key, size))), "trees")
    found = connected(edges)
    return found.toDF("a", "b").union(linked(_with_others(large, found, key, size)))


def sorted_runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows that agree in ``by``, with the runs' bounds."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        if not len(rows):
            continue
        fresh = np.zeros(len(rows), bool)
        fresh[0] = True
        for name in by:
            values = np.asarray(rows.column(name))
            fresh[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(fresh)
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts
        held = rows.slice(starts[-1])
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


def sides(side: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a run to compare with one another: two blocks, or a block with itself."""
    if not side[start]:
        return np.arange(start, end), np.arange(start, end)
    return start + np.flatnonzero(side[start:end] == 1), start + np.flatnonzero(side[start:end] == 2)
