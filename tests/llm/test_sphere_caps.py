import numpy as np
import pytest

from check import compare, database
from tracelake.llm import sphere_caps as caps
from tracelake.llm.queries import ORACLE, op1_sphere_caps

from .conftest import SF


def plain(rows, cosine=0.95):
    """Link counts and components by comparing all pairs."""

    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if usable(v) and i is not None else None for i, v in rows]
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] >= cosine:
                    n[a] += 1
                    n[b] += 1
                    parent[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return sorted((str(rows[k][0]), n[k], str(None if rows[k][0] is None else min(groups[root(k)]))) for k in range(len(rows)))


def got(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in df.collect())


def test_query_equals_sql(spark):
    sf = SF.replace("0.001", "0.01")
    assert compare(op1_sphere_caps(spark, sf), database(sf), ORACLE["op1_sphere_caps"]) == ""


@pytest.mark.parametrize("small, whole", [(False, 8_192), (True, 8_192), (True, 12), (False, 1)])
def test_pairs_around_the_threshold(spark, monkeypatch, small, whole):
    """Also in blocks of a few rows, and with families compared in their caps."""
    monkeypatch.setattr(caps, "WHOLE_ROWS", whole)
    if small:
        monkeypatch.setattr(caps, "CAP_ROWS", 3)
        monkeypatch.setattr(caps, "FAMILY_ROWS", 4)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(15):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for _ in range(rng.integers(1, 40)):
            v = centre + rng.normal(size=64) * rng.choice([0.0, 0.02, 0.028, 0.04])
            rows.append((len(rows), (v * rng.uniform(0.1, 9)).astype(np.float32).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(caps.near_duplicates(df)) == plain(rows)


@pytest.mark.parametrize("whole", [8_192, 1])
def test_an_id_of_several_vectors(spark, monkeypatch, whole):
    monkeypatch.setattr(caps, "WHOLE_ROWS", whole)
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=(3, 32))
    rows = [(7, a), (7, b), (8, a * 1.01 + 0.001 * c), (9, b + 0.001 * a), (9, b + 0.001 * a), (3, b + 0.01 * c), (2, c)]
    rows = [(i, v.tolist()) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(caps.near_duplicates(df)) == plain(rows)


def test_list_decoding_finds_the_closest_filters():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 20))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn, bounds, code = caps.product_code(1, 20, 30)
    score = (x @ turn)[:, : bounds[1]] @ code[0].T
    score = (score[:, :, None] + ((x @ turn)[:, bounds[1] :] @ code[1].T)[:, None, :]).reshape(50, -1)
    best = np.sort(np.argsort(-score, axis=1)[:, : caps.CAPS], axis=1)
    assert (np.sort(caps.list_decode(x, 1, 30), axis=1) == best).all()


def test_pairs_at_the_threshold_share_a_cap():
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(2, 4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    shared = np.zeros(4000, int)
    for code in range(caps.CODES):
        a, b = (caps.list_decode(v, code, 256) for v in (x, y))
        shared += (a[:, :, None] == b[:, None, :]).any(2).sum(1)
    assert shared.min() > 0 and shared.mean() > 10
    apart = np.bitwise_count(caps.sketches(x) ^ caps.sketches(y)).sum(1)
    assert apart.max() <= caps.sketch_distance(0.95)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]),
        (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [2.0, 0.0]), (None, [1.0, 0.0]),
        (10, [1.0, 0.0, 0.0]), (11, [-1.0, 0.0]), (12, [3.0]), (13, [1e-30, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, id int, weight int")
    assert got(caps.near_duplicates(df)) == plain(rows)
    assert caps.near_duplicates(df.limit(0)).count() == 0


def pairs_at(cosine, n, dims):
    x, z = np.random.default_rng(5).normal(size=(2, n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


def test_many_words_part_no_pairs(spark, monkeypatch):
    """The words of nine million vectors, at which four codes part one pair in a hundred."""
    monkeypatch.setattr(caps, "MIN_WORDS", 3_000)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate(pairs_at(0.9501, 600, 16)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(caps.near_duplicates(df)) == plain(rows)


@pytest.mark.parametrize("dims,words", [(1, 64), (2, 64), (3, 64), (4, 300), (16, 1000), (64, 64), (64, 1000)])
def test_codes_keep_the_bound(dims, words):
    codes, own = caps.code_plan(dims, words, 0.95)
    assert caps.CODES <= codes <= caps.MAX_CODES and 1 <= own <= words
    assert caps.parted(dims, own, 0.95) ** codes <= caps.MISSED
