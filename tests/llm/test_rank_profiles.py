"""Profiles against counters of strings, and accuracy on languages that were held out."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import queries, rank_profiles
from tracelake.llm.common import table

SF = "/root/testdata/sf0.001"


def grams(text):
    """N-grams of one to three characters, blanks as spaces, counted one by one."""
    out = Counter()
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    for word in letters.split():
        padded = f" {word} "
        for size in (1, 2, 3):
            out.update(padded[k : k + size] for k in range(len(padded) - size + 1))
    out.pop(" ", None)
    return out


def name(gram):
    codes = [1 if c == " " else ord(c) + 1 for c in gram]
    return sum(c << (21 * k) for k, c in enumerate(codes))


def mean_ranks(counts, most):
    """Name to rank; ties share a mean."""
    order = sorted(((name(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))[:most]
    ranks = {}
    for n in {n for _, n in order}:
        places = [k for k, (_, m) in enumerate(order) if m == n]
        ranks |= {order[k][0]: sum(places) / len(places) for k in places}
    return ranks


@pytest.mark.parametrize("text", ["", "a", "A b,c", "Straße und ÉTÉ 42", "x" * 70_000, "ab " * 50_000, "日本語です"])
def test_grams_equal_plain_counts(text):
    found, counts = rank_profiles.count_grams(rank_profiles.characters(text.encode()))
    want = grams(text)
    assert dict(zip(found.tolist(), counts.tolist())) == {name(g): n for g, n in want.items()}


def test_predictions_equal_plain_distances(spark, documents):
    limits = rank_profiles.Limits(200, 150)
    teach = documents.filter("doc_id % 3 = 0")
    profiles = rank_profiles.learn(teach, limits=limits)
    plain = {}
    for lang in ("de", "en", "es", "fr"):
        total = Counter()
        for r in teach.filter(F.col("lang") == lang).select("text").collect():
            total += grams(r["text"] or "")
        plain[lang] = mean_ranks(total, 200)
    assert profiles.languages == tuple(plain)
    got = documents.select("text", rank_profiles.identify(F.col("text"), profiles).alias("p")).collect()
    for r in got:
        own = mean_ranks(grams(r["text"]), 150)
        far = {k: sum(min(200, abs(v - p.get(g, 1e9))) for g, v in own.items()) for k, p in plain.items()}
        best = sorted(far, key=lambda k: (round(far[k], 6), k))
        assert far[r["p"]["lang_pred"]] == pytest.approx(far[best[0]])
        assert r["p"]["score"] == pytest.approx(far[best[1]] / (far[best[0]] + far[best[1]]))


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    rows = queries.op12_rank_profiles(spark, sf).join(table(spark, sf, "documents"), "doc_id")
    rows = rows.select("doc_id", "held_out", "lang", "lang_pred", "score").collect()
    assert len(rows) == 1_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in tested]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, empty):
    """No letter or no text is unknown, clashing columns are ignored, repeated rows stay."""
    rows = odd.withColumn("lang", F.when(F.col("id") < 4, "en"))
    profiles = rank_profiles.learn(rows)
    assert profiles.languages == ("en",)
    got = rows.select("doc_id", rank_profiles.identify(F.col("text"), profiles).alias("p")).collect()
    assert len(got) == 10
    assert {r["doc_id"] for r in got if r["p"]["lang_pred"] == "und"} == {1, 2, 6}
    assert all(r["p"]["score"] == (0.0 if r["p"]["lang_pred"] == "und" else 1.0) for r in got)
    nothing = rank_profiles.learn(empty.withColumn("lang", F.lit("en")))
    assert nothing.languages == ()
    got = rows.select(rank_profiles.identify(F.col("text"), nothing).alias("p")).distinct().collect()
    assert [tuple(r["p"]) for r in got] == [("und", 0.0)]
    assert empty.select(rank_profiles.identify(F.col("text"), profiles)).count() == 0


def test_partial_counts_are_handed_on(spark, documents, monkeypatch):
    """Counts do not depend on how many n-grams a task holds."""
    import pyarrow as pa

    rows = documents.select("lang", "text").limit(60).toArrow().combine_chunks().to_batches()
    totals = []
    for held in (1 << 20, 3_000):
        monkeypatch.setattr(rank_profiles, "_HELD", held)
        counts = pa.Table.from_batches(list(rank_profiles._count_languages(rows)))
        sums = counts.group_by(["lang", "gram"]).aggregate([("n", "sum")])
        totals.append(sorted(zip(*(c.to_pylist() for c in sums.columns))))
    assert totals[0] == totals[1]
