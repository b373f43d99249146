"""Near-duplicate embeddings by spherical-cap filters from random product codes.

A code turns the space by a random rotation, splits it into ``BLOCKS`` parts and has random
unit words in each; every combination of words, one per part, is a filter direction. A vector
belongs to the caps of the ``CAPS`` directions closest to it, found without trying all
combinations: among the words of each part in order, only those whose ranks multiply to at
most ``CAPS`` can matter. Vectors join on filters, over several codes. The words per part grow
with the root of the number of vectors, so caps hold about the same number at any size. More
words part more pairs: how often a code parts a pair at the threshold is simulated for the
words and each length of vector, and there are as many codes as keep the share of such pairs
that meet in no cap below ``MISSED``.

Equal vectors count once, with their number. In every cap a sketch of sign bits tells which
vectors may be close; those that it connects form families. In a family of up to ``WHOLE_ROWS`` the
cosines of all pairs are computed in double precision. Sketches chain vectors that are far apart, so a
family may be most of the table: in a larger one cosines are computed in each cap, and a pair counts
in the first cap that it shares. All steps work on blocks of bounded size and return counts and
trees, not pairs.

Defined cases: vectors that are null, empty or zero, or hold a null or non-finite component,
link with nothing, as do rows with a null id (null component, kept); vectors of different
lengths are never compared; rows that repeat an id count as vectors of their own.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import written
from tracelake.llm.components import Forest, blocks, connected, sides, sorted_runs, trees
from tracelake.llm.words import mix

CODES, BLOCKS, CAPS = 4, 2, 8
MIN_WORDS = 64
#: Pairs at the threshold that may share no cap; codes beyond which a code has fewer words instead.
MISSED, MAX_CODES = 1e-5, 16
#: Pairs of which the share that a code parts is estimated.
TRIALS = 2_048
SKETCH_BITS = 256
#: Rows of a block.
CAP_ROWS, FAMILY_ROWS = 2_048, 1_024
#: Rows of a family in which all pairs are compared, those of its caps otherwise.
WHOLE_ROWS = 8_192


@lru_cache(maxsize=MAX_CODES)
def product_code(number: int, dims: int, words: int):
    """Rotation, bounds of the parts, and the words of each part."""
    rng = np.random.default_rng([number, dims, words])
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    parts = min(BLOCKS, dims)
    bounds = np.linspace(0, dims, parts + 1).astype(int)
    code = []
    for a, b in zip(bounds, bounds[1:]):
        w = rng.normal(size=(words, b - a))
        code.append(w / np.linalg.norm(w, axis=1)[:, None])
    return turn, bounds, code


@lru_cache(maxsize=8)
def rank_tuples(parts: int, caps: int, words: int) -> np.ndarray:
    """Ranks, one per part, of the combinations that can be among the ``caps`` best."""
    tuples = [((), 1)]
    for _ in range(parts):
        tuples = [
            ((*t, r), p * (r + 1)) for t, p in tuples for r in range(min(words, caps)) if p * (r + 1) <= caps
        ]
    return np.array([t for t, _ in tuples])


def list_decode(x: np.ndarray, number: int, words: int, caps: int = CAPS) -> np.ndarray:
    """Numbers of the ``caps`` filter directions closest to each unit vector."""
    turn, bounds, code = product_code(number, x.shape[1], words)
    turned = x @ turn
    ranks = rank_tuples(len(code), caps, words)
    total, name = np.zeros((len(x), len(ranks))), np.zeros((len(x), len(ranks)), np.int64)
    for k, w in enumerate(code):
        score = turned[:, bounds[k] : bounds[k + 1]] @ w.T
        order = np.argsort(-score, axis=1, kind="stable")[:, : min(words, caps)]
        total += np.take_along_axis(score, order, 1)[:, ranks[:, k]]
        name = name * words + order[:, ranks[:, k]]
    best = np.argsort(-total, axis=1, kind="stable")[:, :caps]
    return np.take_along_axis(name, best, 1)


def parted(dims: int, words: int, cosine: float) -> float:
    """Share of pairs at the cosine that meet in no cap of a code, three standard errors up."""
    rng, none = np.random.default_rng([dims, words]), 0
    for number in range(CODES):
        x, z = rng.normal(size=(2, TRIALS // CODES, dims))
        x /= np.linalg.norm(x, axis=1)[:, None]
        z -= (z * x).sum(1)[:, None] * x
        z /= np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
        y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z
        a, b = (list_decode(v, number, words) for v in (x, y))
        none += int((~(a[:, :, None] == b[:, None, :]).any((1, 2))).sum())
    return min(1.0, (none + 3 * math.sqrt(none) + 3) / TRIALS)


def code_plan(dims: int, words: int, cosine: float) -> tuple[int, int]:
    """Codes and words of each part that keep the share of missed pairs below ``MISSED``."""
    while True:
        share = parted(dims, words, cosine)
        codes = math.ceil(math.log(MISSED) / math.log(share)) if share < 1 else MAX_CODES + 1
        if codes <= MAX_CODES or words == 1:
            return min(max(CODES, codes), MAX_CODES), words
        words = max(1, words // 2)


@lru_cache(maxsize=8)
def _planes(dims: int) -> np.ndarray:
    return np.random.default_rng([dims, SKETCH_BITS]).normal(size=(dims, SKETCH_BITS))


def sketches(x: np.ndarray) -> np.ndarray:
    return np.packbits(x @ _planes(x.shape[1]) > 0, axis=1)


def sketch_distance(cosine: float) -> int:
    """Differing bits that hardly any pair at the cosine exceeds (five standard deviations)."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH_BITS * p + 5 * math.sqrt(SKETCH_BITS * p * (1 - p)))


def by_length(column: pa.Array):
    """Row numbers and unit vectors in double precision, for each length of vector."""
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), float)
    first = np.cumsum(lengths) - lengths
    for dims in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dims)
        x = values[first[rows][:, None] + np.arange(dims)]
        x = x / np.abs(x).max(1)[:, None]
        yield rows, x / np.linalg.norm(x, axis=1)[:, None]


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vector, doc, weight``: each usable vector once, with its smallest id and its number."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vector").agg(F.min("id").alias("doc"), F.count("*").alias("weight"))


def caps(vectors: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """``cap, id, sketch`` for every cap that holds a vector; codes and words by length."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = np.asarray(part.column("id"))
                for rows, x in by_length(part.column("vector")):
                    bits = pa.array([b.tobytes() for b in sketches(x)], pa.binary())
                    codes, words = plans[x.shape[1]]
                    for number in range(codes):
                        found = list_decode(x, number, words)
                        salt = np.uint64(number * 65_537 + x.shape[1])
                        cap = mix(found.astype(np.uint64) + mix(np.full(1, salt, np.uint64)))
                        own = np.repeat(np.arange(len(rows)), found.shape[1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cap.ravel().view(np.int64)), pa.array(ids[rows][own]), bits.take(pa.array(own))],
                            ["cap", "id", "sketch"],
                        )

    return vectors.select("id", "vector").mapInArrow(run, "cap long, id long, sketch binary")


def _edges(ids, edges) -> tuple[pa.Array, pa.Array]:
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())


def near_edges(members: DataFrame, distance: int) -> DataFrame:
    """Trees that connect the vectors of each cap through pairs of near sketches."""

    def run(batches):
        for rows, bounds in sorted_runs(batches, "cap", "block"):
            ids, side = np.asarray(rows.column("id")), np.asarray(rows.column("side"))
            bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64)
            bits, forest = bits.reshape(len(ids), -1), Forest(len(ids))
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                left, right = sides(side, start, end)
                for at in range(0, len(left), 128):
                    part = left[at : at + 128]
                    apart = np.zeros((len(part), len(right)), np.int16)
                    for k in range(bits.shape[1]):
                        apart += np.bitwise_count(bits[part, k][:, None] ^ bits[right, k][None, :])
                    a, b = np.nonzero((apart <= distance) & (part[:, None] != right[None, :]))
                    forest.join_all(part[a], right[b])
            yield pa.RecordBatch.from_arrays(list(_edges(ids, forest.edges)), ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def clear_met(close: np.ndarray, left: np.ndarray, right: np.ndarray, caps: pa.Array, cap: int) -> None:
    """Take out of ``close`` the pairs that share a cap smaller than ``cap``."""
    sizes = np.asarray(caps.value_lengths())
    owner, names = np.repeat(np.arange(len(sizes)), sizes), np.asarray(caps.flatten())
    owner, names = owner[names < cap], names[names < cap]
    order = np.argsort(names, kind="stable")
    at = np.full(len(sizes), -1), np.full(len(sizes), -1)
    at[0][left], at[1][right] = np.arange(len(left)), np.arange(len(right))
    for rows in np.split(owner[order], np.flatnonzero(np.diff(names[order])) + 1):
        if len(rows) > 1:
            a, b = (x[rows] for x in at)
            close[np.ix_(a[a >= 0], b[b >= 0])] = False


def verified(groups: DataFrame, key: str, cosine: float) -> DataFrame:
    """``a, b, links``: counts of links (``b`` null) and trees of links, by block of family or cap.

    Rows in caps have ``caps``, all that their vector belongs to; their pairs count in the first they share.
    """
    in_caps = key == "cap"

    def run(batches):
        for rows, bounds in sorted_runs(batches, key, "block"):
            ids, side = np.asarray(rows.column("id")), np.asarray(rows.column("side"))
            weight = np.asarray(rows.column("weight")).astype(np.int64)
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            vectors = rows.column("vector").combine_chunks()
            lengths = np.asarray(vectors.value_lengths())
            unit = np.zeros((len(ids), lengths.max()))
            for at, x in by_length(vectors):
                unit[at, : x.shape[1]] = x
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                left, right = sides(side, start, end)
                close = unit[left] @ unit[right].T >= cosine
                close &= (left[:, None] != right[None, :]) & (lengths[left][:, None] == lengths[right][None, :])
                if in_caps and close.any():
                    caps = rows.column("caps").slice(start, end - start).combine_chunks()
                    clear_met(close, left - start, right - start, caps, rows.column(key)[start].as_py())
                links[left] += close @ weight[right]
                if side[start]:
                    links[right] += weight[left] @ close
                x, y = np.nonzero(close)
                forest.join_all(left[x], right[y])
            some = np.flatnonzero(links)
            a, b = _edges(ids, forest.edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(ids[some]), a]),
                    pa.concat_arrays([pa.nulls(len(some), pa.int64()), b]),
                    pa.concat_arrays([pa.array(links[some]), pa.array(np.zeros(len(a), np.int64))]),
                ],
                ["a", "b", "links"],
            )

    return groups.mapInArrow(run, "a long, b long, links long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row; ids are integers."""
    # Vectors are known by numbers of their own, as an id may name several.
    single = distinct_vectors(vectors, id_col, vector_col).withColumn("id", F.monotonically_increasing_id())
    single = written(single, "vectors")
    words = max(MIN_WORDS, math.ceil(math.sqrt(single.count())))
    lengths = [r["dims"] for r in single.select(F.size("vector").alias("dims")).distinct().collect()]
    held = written(caps(single, {d: code_plan(d, words, cosine) for d in lengths}), "caps")
    shared = written(held.groupBy("cap").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    distance = sketch_distance(cosine)
    near = connected(trees(held.join(shared, "cap"), shared, "cap", CAP_ROWS, lambda rows: near_edges(rows, distance)))
    near = written(near.select("id", F.col("component").alias("family")), "families")
    sizes = written(near.groupBy("family").agg(F.count("*").alias("n")), "sizes")
    families = near.join(sizes.filter(F.col("n") <= WHOLE_ROWS), "family").join(single, "id")
    found = verified(blocks(families, "family", FAMILY_ROWS), "family", cosine)
    large = sizes.filter(F.col("n") > WHOLE_ROWS)
    if not large.isEmpty():
        many = near.join(large.select("family"), "family", "left_semi").select("id")
        rows = written(held.drop("sketch").join(many, "id", "left_semi"), "large")
        own_caps = rows.groupBy("id").agg(F.collect_list("cap").alias("caps"))
        rows = rows.join(rows.groupBy("cap").agg(F.count("*").alias("n")).filter("n > 1"), "cap")
        rows = rows.join(own_caps, "id").join(single, "id")
        found = found.union(verified(blocks(rows, "cap", FAMILY_ROWS), "cap", cosine))
    found = written(found, "links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    linked = single.select("id", "doc").join(connected(found.filter("b IS NOT NULL")), "id")
    least = linked.groupBy("component").agg(F.min("doc").alias("least"))
    linked = linked.join(least, "component").select("id", "least")
    own = single.join(counts, "id", "left").join(linked, "id", "left")
    own = own.select(
        F.col("vector").alias("__vector"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("__links"),
        F.coalesce("least", "doc").alias("__component"),
    )
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    known = F.when(F.col("id").isNotNull(), F.col("vector"))
    rows = rows.join(own, known == F.col("__vector"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("__component", "id"))
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )
