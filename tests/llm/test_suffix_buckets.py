import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from check import compare, database
from tracelake.llm import suffix_buckets as sb
from tracelake.llm.queries import ORACLE, op4_suffix_buckets

from .conftest import SF, odd_rows


def plain(rows, size):
    """Removed bytes of every text, by counting all strings of the size."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for text in texts:
        mask = np.zeros(len(text) + 1, int)
        for i in range(len(text) - size + 1):
            if seen[text[i : i + size]] > 1:
                mask[i] += 1
                mask[i + size] -= 1 if i + size <= len(text) else 0
        gone = np.cumsum(mask)[: len(text)] > 0
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, size):
    out = []
    for r in sb.remove_repeats(df, min_bytes=size).collect():
        spans = [(s["begin"], s["end"]) for s in r["cut"]["spans"]]
        kept = hashlib.sha256(bytes(r["cut"]["kept"])).hexdigest()
        out.append((str(r["doc_id"]), len((r["text"] or "").encode()), sum(b - a for a, b in spans), len(spans), kept))
    return sorted(out)


def want(rows, size):
    return sorted((str(r[0]), *p) for r, p in zip(rows, plain(rows, size)))


def test_query_equals_sql(spark):
    assert compare(op4_suffix_buckets(spark, SF), database(SF), ORACLE["op4_suffix_buckets"]) == ""


def test_query_equals_plain_counting(spark, texts):
    rows = sorted(texts.items())
    got = sorted(tuple(r) for r in op4_suffix_buckets(spark, SF).collect())
    assert got == [(i, *p) for (i, _), p in zip(rows, plain(rows, 400))]
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("small", [False, True])
def test_passages_edits_and_periods(spark, monkeypatch, small):
    if small:  # buckets that the shuffle refines, texts taken in parts
        monkeypatch.setattr(sb, "BUCKET_ROWS", 2)
        monkeypatch.setattr(sb.window_runs, "__defaults__", (64,))
    rng = random.Random(2)
    make = lambda n, letters="abcdé 日": "".join(rng.choice(letters) for _ in range(n))
    passages = [make(n) for n in (15, 20, 30, 60, 120)]
    rows = []
    for _ in range(80):
        text = make(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            passage = rng.choice(passages)
            if rng.random() < 0.5:
                k = rng.randrange(len(passage))
                passage = passage[:k] + make(1) + passage[k + 1 :]
            text += passage + make(rng.randrange(30))
        rows.append((len(rows), text))
    rows += [(100, "a" * 300), (101, "ab" * 70), (102, "abc" * 40 + "x"), (103, "z" * 40), (104, "z" * 41), (105, "y" * 39)]
    rows += [(106, rows[0][1]), (107, make(90) * 2), (108, "qrs" * 13 + "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 40) == want(rows, 40)


def test_sliding_least():
    rng = np.random.default_rng(0)
    for n, width in ((5, 5), (17, 4), (100, 7)):
        values = rng.integers(0, 1 << 60, n).astype(np.uint64)
        assert sb.sliding_least(values, width).tolist() == [values[i : i + width].min() for i in range(n - width + 1)]


def test_odd_rows(spark, odd, empty):
    rows = [(r[0], r[1][:3000] if r[1] else r[1]) for r in odd_rows()]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key long, spans int")
    assert found(df, 400) == want(rows, 400)
    assert sb.remove_repeats(empty).count() == 0
    whole = {str(r["doc_id"]): r for r in sb.remove_repeats(odd).collect()}
    assert bytes(whole["5"]["cut"]["kept"]) == b""  # its repeated row has all of it
    assert whole["5"]["ids"] == "d"


def test_repeated_rows_share_their_spans(spark):
    """Rows of one text without an id have the spans of one row, not of all."""
    text = " ".join(f"w{k * k % 9973}" for k in range(500))
    rows = spark.createDataFrame([(None, text)] * 300, "doc_id long, text string")
    spans = sb.repeated_spans(rows).collect()
    assert len(spans) == 1 and len(spans[0]["spans"]) < 100
    cut = sb.remove_repeats(rows).select("cut.text", "cut.spans").distinct().collect()
    assert [(r["text"], len(r["spans"])) for r in cut] == [("", 1)]
