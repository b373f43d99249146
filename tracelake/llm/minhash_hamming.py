"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A document's set is its distinct word shingles. Its signature is ``CHUNKS * WIDTH`` symbols of
16 bits (b-bit MinHash); distance counts the symbols that differ. The signature is split into
chunks: two signatures that differ in less than ``CHUNKS * (ERRORS + 1)`` places have, by
pigeonhole, a chunk with at most ``ERRORS`` errors. The allowed errors are enumerated by leaving
each symbol of the chunk out in turn, so such pairs meet in a bucket of equal remaining symbols
(64 bits): all pairs up to ``CHUNKS * 2 - 1`` differences do, and at similarity 0.80 all but two in
100,000 of the others.

Documents of equal sets count once from the start. In every bucket a longer sketch tells
which rows may be similar enough; rows that it connects form families, far smaller than the
whole. Inside a family, pairs that the sketch allows are confirmed on the full sets until the
family's components are known. Both steps work on blocks of bounded size and return trees, not
pairs: no bucket or family has to fit a task, and no two rows are linked unconfirmed. Rows of a large
bucket or family meet a first block, and those it does not connect meet all others (``trees``).

Defined cases: a text without words has an empty set, size 0, and is linked with nothing; a null
id links with nothing (null component, kept); rows that repeat an id and its text are returned
each, in the same class; if an id names several texts, each is compared with all others and its
row has the class of its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import keyed_text, slabs, written
from tracelake.llm.components import Forest, connected, sides, sorted_runs, trees
from tracelake.llm.words import eights, mix, name_spans, per_text, shingles, word_spans

_U = np.uint64
SHINGLE_WORDS = 5
CHUNKS, WIDTH, ERRORS = 8, 5, 1
#: Symbols of the sketch that decides which pairs are confirmed, one byte each.
SKETCH = 128
#: Rows of a block.
BUCKET_ROWS, FAMILY_ROWS = 2_048, 1_024
#: Rows that a row is compared with at once, and slots of the table that spares most of them.
LINK_ROWS, SLOTS = 256, 1 << 22

_random = np.random.default_rng(85)
_MULTIPLY = _random.integers(1, 1 << 63, CHUNKS * WIDTH + SKETCH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _random.integers(1, 1 << 63, CHUNKS * WIDTH + SKETCH, dtype=np.uint64)
_SET = "set_a long, set_b long, n_shingles long, signature binary, sketch binary"


def sketch_matches(threshold: float) -> int:
    """Equal symbols that a pair at the threshold has but for about one in 300,000."""
    return int(np.floor(SKETCH * threshold - 4.5 * np.sqrt(SKETCH * threshold * (1 - threshold))))


def text_shingles(raw: np.ndarray, offsets: np.ndarray, words: int):
    """Shingle hashes of texts that lie end to end, and each text's first."""
    start, end, first = word_spans(raw, offsets)
    return shingles(name_spans(eights(raw, lower=True), start, end), first, words)


def set_name(elements: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that tell sets of distinct hashes apart."""
    return mix(elements).sum(), mix(elements ^ _ADD[0]).sum()


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """``id``, the set's 128-bit name and size, signature and sketch of every text."""
    rows = keyed_text(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            for begin, end, raw, offsets in slabs(batch):
                hashes, bounds = text_shingles(raw, offsets, words)
                least = [
                    per_text(np.minimum, hashes * m + a, bounds, _U(0)) for m, a in zip(_MULTIPLY, _ADD)
                ]
                symbols = mix(np.stack(least, axis=1))
                signature = (symbols[:, : CHUNKS * WIDTH] >> _U(48)).astype("<u2")
                sketch = (symbols[:, CHUNKS * WIDTH :] >> _U(56)).astype(np.uint8)
                names = np.zeros((3, end - begin), np.uint64)
                for k in range(end - begin):
                    own = np.sort(hashes[bounds[k] : bounds[k + 1]])
                    if len(own):
                        own = own[np.append(True, own[1:] != own[:-1])]
                    names[:, k] = *set_name(own), len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(begin, end - begin),
                        *(pa.array(x.view(np.int64)) for x in names),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    ["id", "set_a", "set_b", "n_shingles", "signature", "sketch"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {_SET}")


def bucket_keys(sets: DataFrame) -> DataFrame:
    """``key, id`` for every chunk of every signature and every symbol left out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            joined = b"".join(batch.column("signature").to_pylist())
            symbols = np.frombuffer(joined, "<u2").astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
            ids = batch.column("id")
            for chunk in range(CHUNKS):
                for skip in range(WIDTH):
                    rest = np.delete(symbols[:, chunk], skip, axis=1)
                    packed = rest[:, 0]
                    for k in range(1, WIDTH - ERRORS):
                        packed = packed << _U(16) | rest[:, k]
                    key = mix(packed ^ mix(np.full(1, chunk * WIDTH + skip + 1, np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], ["key", "id"])

    return sets.select("id", "signature").mapInArrow(run, "key long, id long")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SKETCH)


def _near(sketch: np.ndarray, rows: np.ndarray, columns: np.ndarray, matches: int):
    """Pairs of ``rows`` and later ``columns`` whose sketches agree enough."""
    for at in range(0, len(rows), 64):
        part = rows[at : at + 64]
        same = np.zeros((len(part), len(columns)), np.int16)
        for k in range(0, sketch.shape[1], 16):
            same += (sketch[part, None, k : k + 16] == sketch[None, columns, k : k + 16]).sum(2, dtype=np.int16)
        same[part[:, None] == columns[None, :]] = 0
        a, b = np.nonzero(same >= matches)
        yield part[a], columns[b], same[a, b]


def _edges(ids: np.ndarray, edges) -> pa.RecordBatch:
    a, b = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])


def near_edges(members: DataFrame, matches: int) -> DataFrame:
    """Trees that connect the rows of each bucket through pairs of near sketches."""

    def run(batches):
        for rows, bounds in sorted_runs(batches, "key", "block"):
            ids, sketch = np.asarray(rows.column("id")), _matrix(rows.column("sketch"))
            side, forest = np.asarray(rows.column("side")), Forest(len(ids))
            sizes = np.diff(bounds)
            twos = bounds[:-1][sizes == 2]
            agree = (sketch[twos] == sketch[twos + 1]).sum(1)
            for x in twos[agree >= matches].tolist():
                forest.join(x, x + 1)
            for k in np.flatnonzero(sizes > 2).tolist():
                for a, b, _ in _near(sketch, *sides(side, bounds[k], bounds[k + 1]), matches):
                    forest.join_all(a, b)
            yield _edges(ids, forest.edges)

    return members.mapInArrow(run, "a long, b long")


def shared_elements(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def link_row(x: int, others: np.ndarray, sets: list[np.ndarray], percent: int, forest: Forest, table: np.ndarray) -> None:
    """Join row ``x`` with those of ``others`` it is linked with, as far as they are not joined.

    ``table`` (zeros, returned as such) has a slot for the high bits of an element. Elements of another row whose
    slots ``x`` has are as many as both share or more, so that few pairs which are not links are compared.
    """
    shift = _U(65 - len(table).bit_length())
    for at in range(0, len(others), LINK_ROWS):
        left = others[at : at + LINK_ROWS]
        left = left[forest.roots(left) != forest.root(x)]
        if not len(left):
            continue
        sizes = np.array([len(sets[y]) for y in left])
        table[sets[x] >> shift] = 1
        most = table[np.concatenate([sets[y] for y in left]) >> shift]
        most = np.add.reduceat(most, np.cumsum(sizes) - sizes, dtype=np.int64)
        table[sets[x] >> shift] = 0
        left = left[100 * most >= percent * (len(sets[x]) + sizes - most)]
        while len(left):
            if linked(sets[x], sets[left[0]], percent):
                forest.join(x, int(left[0]))
                left = left[forest.roots(left) != forest.root(x)]
            else:
                left = left[1:]


def confirmed_edges(families: DataFrame, matches: int, percent: int) -> DataFrame:
    """Trees that connect the rows of each family through links confirmed on full sets."""

    def run(batches):
        table = np.zeros(SLOTS, np.uint8)
        for rows, bounds in sorted_runs(batches, "family", "block"):
            ids, sketch = np.asarray(rows.column("id")), _matrix(rows.column("sketch"))
            side, forest = np.asarray(rows.column("side")), Forest(len(ids))
            sets = [np.frombuffer(s, "<u8") for s in rows.column("elements").to_pylist()]
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                for a, b, same in _near(sketch, *sides(side, start, end), matches):
                    apart = forest.roots(a) != forest.roots(b)
                    if not side[start]:
                        apart &= a < b
                    a, b, same = a[apart], b[apart], same[apart]
                    order = np.lexsort((-same, a))  # likely links first spare the others
                    a, b = a[order], b[order]
                    firsts = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else []
                    for x, others in zip(a[firsts].tolist(), np.split(b, firsts[1:])):
                        link_row(x, others, sets, percent, forest, table)
            yield _edges(ids, forest.edges)

    return families.mapInArrow(run, "a long, b long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, by their exact sizes."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = shared_elements(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``set_a, set_b, elements``: name and sorted distinct shingle hashes of every text's set, packed."""

    def run(batches):
        for batch in batches:
            for begin, end, raw, offsets in slabs(batch):
                hashes, bounds = text_shingles(raw, offsets, words)
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
                names = np.array([set_name(s) for s in sets], np.uint64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in names),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["set_a", "set_b", "elements"],
                )

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "set_a long, set_b long, elements binary")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    words: int = SHINGLE_WORDS,
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    Links are pairs with ``100 * intersection >= percent * union``; ids are integers.
    """
    matches = sketch_matches(percent / 100)
    named = written(signatures(docs, id_col, text_col, words), "signatures")
    usable = named.filter("id IS NOT NULL AND n_shingles > 0")
    # Equal sets are one class, known by a number of its own, as an id may name several texts.
    classes = usable.groupBy("set_a", "set_b").agg(
        F.min("id").alias("doc"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")
    )
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = classes.select("id", "signature", "sketch")
    names = classes.select("id", "doc", "set_a", "set_b")

    keys = bucket_keys(reps)
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = keys.join(shared, "key").join(reps.select("id", "sketch"), "id")
    near = connected(trees(members, shared, "key", BUCKET_ROWS, lambda rows: near_edges(rows, matches)))

    near = written(near.select("id", F.col("component").alias("family")), "families")
    wanted = near.join(names, "id")
    sets = full_sets(docs.join(wanted.select(F.col("doc").alias(id_col)), id_col, "left_semi"), id_col, text_col, words)
    sets = sets.groupBy("set_a", "set_b").agg(F.min("elements").alias("elements"))
    sets = sets.join(wanted.select("id", "set_a", "set_b"), ["set_a", "set_b"]).select("id", "elements")
    sizes = written(near.groupBy("family").agg(F.count("*").alias("n")), "sizes")
    family = near.join(sizes, "family").join(reps.drop("signature"), "id").join(sets, "id")
    links = trees(family, sizes, "family", FAMILY_ROWS, lambda rows: confirmed_edges(rows, matches, percent))
    found = connected(links)

    # A component is known by the smallest document id of its classes.
    linked_docs = names.join(found, "id")
    least = linked_docs.groupBy("component").agg(F.min("doc").alias("least"))
    linked_docs = linked_docs.join(least, "component").select("id", "least")
    own = names.join(linked_docs, "id", "left")
    own = own.select("set_a", "set_b", F.coalesce("least", "doc").alias("component"))
    result = named.select("id", "set_a", "set_b", "n_shingles").join(own, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    result = result.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), component).alias("component_id"))
    kept = F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id"))
    return result.withColumn("kept", kept)
