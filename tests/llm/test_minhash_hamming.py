import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, database
from tracelake.llm import components
from tracelake.llm import minhash_hamming as mh
from tracelake.llm.common import written
from tracelake.llm.queries import ORACLE, op3_minhash_hamming

from .conftest import SF, odd_rows


def plain_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_classes(rows, percent=85):
    """Component of every id by comparing all pairs."""
    sets = {i: plain_set(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_sql(spark):
    assert compare(op3_minhash_hamming(spark, SF), database(SF), ORACLE["op3_minhash_hamming"]) == ""


def test_query_equals_all_pairs(spark, texts):
    rows = op3_minhash_hamming(spark, SF)
    assert got(rows) == plain_classes(texts.items())
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows.collect())


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_around_the_threshold(spark, monkeypatch, small):
    """Families of edited copies, many pairs just below and above the threshold."""
    if small:  # buckets and families that need several blocks
        monkeypatch.setattr(mh, "BUCKET_ROWS", 3)
        monkeypatch.setattr(mh, "FAMILY_ROWS", 4)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):
        base = rng.choices(words, k=rng.choice([30, 120, 400]))
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(mh.near_duplicates(df)) == plain_classes(rows)


def test_keys_meet_within_the_distance():
    """Signatures that differ in CHUNKS * 2 - 1 places share a bucket."""
    rng = np.random.default_rng(0)
    n = mh.CHUNKS * mh.WIDTH
    for _ in range(200):
        a = rng.integers(0, 1 << 16, n)
        b = a.copy()
        b[rng.permutation(n)[: mh.CHUNKS * (mh.ERRORS + 1) - 1]] += 1
        same = (a == b).reshape(mh.CHUNKS, mh.WIDTH).sum(1)
        assert same.max() >= mh.WIDTH - mh.ERRORS


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    star = [(7, i) for i in range(300, 500)]
    loose = [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(280)]
    edges = chain + star + loose + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    found = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {r["id"]: r["component"] for r in found} == {i: root(i) for i in parent}
    assert len(found) == len(parent)
    none = spark.createDataFrame([], "a long, b long")
    assert components.connected(none).count() == 0


def test_odd_rows(spark, odd, empty):
    rows = mh.near_duplicates(odd.withColumnRenamed("ids", "component_id")).collect()
    want = plain_classes({i: t for i, t, *_ in odd_rows() if i is not None}.items())
    assert len(rows) == len(odd_rows())
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert mh.near_duplicates(empty).count() == 0


def test_every_text_of_an_id_is_compared(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):  # id k names two texts, each with a near copy of its own
        for copy in (1_000 + k, 2_000 + k):
            base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
            rows += [(k, " ".join(base)), (copy, " ".join(base[:-1]))]
    rows.append((-1, rows[2][1] + " more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = mh.near_duplicates(df).collect()
    want = sorted((d, len(plain_set(t)), -1 if n in (2, 3, 80) else rows[n // 2 * 2][0]) for n, (d, t) in enumerate(rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted([-1, *range(20), *range(20)])


@pytest.mark.parametrize("size", [2, 5, 40])
def test_trees_connect_as_all_links_do(spark, size):
    """Rows of a key are numbers, linked at a distance of 3 or less: large keys, outsiders, several components."""
    rng = np.random.default_rng(size)
    numbers = {0: range(60), 1: [*range(0, 60, 2), *range(100, 140, 9)], 2: rng.choice(400, 50, replace=False), 3: [5, 500]}
    rows = [(1000 * key + int(x), key, int(x)) for key, xs in numbers.items() for x in xs]

    def linked(blocks):
        def run(batches):
            for table, bounds in components.sorted_runs(batches, "key", "block"):
                ids, x = np.asarray(table.column("id")), np.asarray(table.column("x"))
                side, forest = np.asarray(table.column("side")), components.Forest(len(ids))
                for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    left, right = components.sides(side, start, end)
                    a, b = np.nonzero(np.abs(x[left][:, None] - x[right][None, :]) <= 3)
                    forest.join_all(left[a], right[b])
                ends = np.array(forest.edges, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[e]) for e in ends], ["a", "b"])

        return blocks.mapInArrow(run, "a long, b long")

    members = spark.createDataFrame(rows, "id long, key long, x long")
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    edges = components.trees(members.join(sizes, "key"), sizes, "key", size, linked)
    found = {r["id"]: r["component"] for r in components.connected(edges).collect()}
    want = {}
    for key, xs in numbers.items():
        first = last = None
        for x in sorted(int(x) for x in xs):
            first = x if last is None or x - last > 3 else first
            last, want[1000 * key + x] = x, 1000 * key + first
    assert {i: found.get(i, i) for i in want} == want


def test_a_hub_and_its_chain(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(500, 560)] + [(399, 560), (None, 3)]
    found = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["component"] for r in found} == {0} and len(found) == 461


def test_components_take_few_rounds(spark, monkeypatch):
    """Tasks contract what they hold: a path of 400 nodes and 3,000 loose ends are written six times at most."""
    names = []
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or written(df, name))
    edges = [(k, k + 1) for k in range(400)] + [(10_000 + k, 20_000 + k // 2) for k in range(3_000)]
    random.Random(2).shuffle(edges)
    found = components.connected(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()
    assert {r["id"]: r["component"] for r in found if r["id"] <= 400} == dict.fromkeys(range(401), 0)
    assert len(found) == 401 + 4_500 and len({r["component"] for r in found}) == 1 + 1_500
    assert len(names) <= 6


@pytest.mark.parametrize("part", [2, 7, 1 << 18])
def test_parts_of_edges_are_joined_by_rounds(spark, monkeypatch, part):
    """Contracted in parts so small that only the rounds can join them: a path, a star around its largest, loose edges."""
    monkeypatch.setattr(components, "EDGE_ROWS", part)
    rng = random.Random(part)
    names = rng.sample(range(1_000), 150)
    edges = list(zip(names, names[1:])) + [(5_000, k) for k in range(3_000, 3_060)]
    edges += [(rng.randrange(6_000, 6_090), rng.randrange(6_000, 6_090)) for _ in range(45)]
    rng.shuffle(edges)
    ends = np.unique(np.array(edges))
    least = ends[components.smallest(*np.searchsorted(ends, np.array(edges).T), len(ends))]
    schema = "a long, b long"
    found = components.connected(spark.createDataFrame(edges, schema).repartition(8)).collect()
    want = {int(i): int(c) for i, c in zip(ends, least)}
    loose = {i for i in want if i not in {x for a, b in edges if a != b for x in (a, b)}}
    assert {r["id"]: r["component"] for r in found} == {i: c for i, c in want.items() if i not in loose}
    assert {want[i] for i in names} == {min(names)} and want[5_000] == 3_000


def test_a_block_of_near_copies_takes_little_memory():
    """All pairs of 2,048 rows are near; half of the rows are linked, the others are compared in vain."""
    rng = np.random.default_rng(3)
    n, base = 2_048, rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    kept = np.where(np.arange(n) % 2, 80, 97)  # elements of the base that a row keeps
    sets = [np.sort(np.append(base[:k], rng.integers(0, 1 << 62, 100 - k, dtype=np.uint64))) for k in kept]
    columns = {"id": range(n), "family": [0] * n, "block": [0] * n, "side": [0] * n}
    columns |= {"sketch": [bytes(mh.SKETCH)] * n, "elements": [s.tobytes() for s in sets]}
    rows = pa.RecordBatch.from_pydict(columns)
    families = SimpleNamespace(mapInArrow=lambda run, schema: list(run(iter([rows]))))
    tracemalloc.start()
    (edges,) = mh.confirmed_edges(families, mh.sketch_matches(0.85), 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parent = components.smallest(*(np.asarray(edges.column(c)) for c in ("a", "b")), n)
    want = np.arange(n)
    want[::2] = 0
    assert (parent == want).all()
    assert peak < 64e6, f"{peak / 1e6:.0f} MB"


def test_rows_are_linked_as_one_by_one(monkeypatch):
    """Few slots: bounds that are too high spare fewer pairs and change nothing."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(mh, "LINK_ROWS", 7)
    base = rng.integers(0, 1 << 63, (3, 60), dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.06, rng.integers(0, 1 << 63, 60, dtype=np.uint64), base[k % 3])) for k in range(90)]
    plain = components.Forest(90)
    for x in range(90):
        for y in range(x + 1, 90):
            if mh.linked(sets[x], sets[y], 85):
                plain.join(x, y)
    assert 3 < len(set(plain.roots(np.arange(90)).tolist())) < 60
    for slots in (1, 64, 1 << 22):
        forest, table = components.Forest(90), np.zeros(slots, np.uint8)
        for x in range(90):
            mh.link_row(x, rng.permutation(np.arange(x + 1, 90)), sets, 85, forest, table)
        assert (forest.roots(np.arange(90)) == plain.roots(np.arange(90))).all() and not table.any()
