import numpy as np

from tracelake.llm import minhash_hamming, rule_forest
from tracelake.llm.words import eights, name_spans


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


FIRST = thue_morse(1024)
SECOND = FIRST.translate(str.maketrans("ab", "ba"))


def test_names_tell_spans_apart():
    """Equal bytes at any place have one name, all others another; lower-casing counts when asked for."""
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 4_000).astype(np.uint8)
    start = rng.integers(0, 3_900, 3_000)
    end = start + rng.integers(0, 40, 3_000)
    names = name_spans(eights(raw), start, end)
    by_name, by_bytes = {}, {}
    for a, b, name in zip(start, end, names.tolist()):
        by_name.setdefault(name, set()).add(raw[a:b].tobytes())
        by_bytes.setdefault(raw[a:b].tobytes(), set()).add(name)
    assert all(len(x) == 1 for x in [*by_name.values(), *by_bytes.values()])
    mixed = np.frombuffer(b"aBcZ\x00abcz" + "É".encode(), np.uint8)
    lower = name_spans(eights(mixed, lower=True), np.array([0, 5]), np.array([4, 9]))
    assert lower[0] == lower[1]
    assert len(set(name_spans(eights(mixed), np.array([0, 5, 4, 0]), np.array([4, 9, 5, 0])).tolist())) == 4


def test_texts_that_cancel_out_in_a_rolling_hash(spark):
    """No shingle, line or window is taken for another."""
    rows = [(1, FIRST, "x"), (2, SECOND, "x"), (3, f"{FIRST}\n{SECOND}", "x"), (4, f"{FIRST}\n{FIRST}", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    classes = {r["doc_id"]: r["component_id"] for r in minhash_hamming.near_duplicates(docs).collect()}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 4}
    lines = {r["doc_id"]: r["n_dup_lines"] for r in rule_forest.statistics(docs).collect()}
    assert lines == {1: 0, 2: 0, 3: 0, 4: 1}
