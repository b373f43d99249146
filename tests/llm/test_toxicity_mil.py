import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import toxicity_mil as mil
from tracelake.llm.common import table
from tracelake.llm.queries import op8_toxicity_mil

from .conftest import SF, odd_rows


def hashes(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    _, _, kinds, _, _ = mil.sentence_features(raw, np.array([0, len(raw)]))
    return [int(k[0]) for k in kinds]


def plain_score(text, model):
    """Noisy-or over sentences, one after another."""
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", text or ""):
        words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", sentence)
        if words:
            found = {h for w in words for h in hashes(w)}
            z = model.bias + sum(weight.get(h, 0.0) for h in found)
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def model_of(words):
    found = sorted({h for w in words for h in hashes(w)})
    return mil.Model(np.array(found, np.uint64), np.linspace(0.5, 3, len(found)), -4.0)


def test_scores_equal_plain_noisy_or(spark, documents, texts):
    model = model_of(["the", "Idiot", "élan", "en", "thb", "Trash"])
    got = {r["doc_id"]: r["score"] for r in mil.score(documents, model).collect()}
    for i in sorted(texts)[:60]:
        assert math.isclose(got[i], plain_score(texts[i], model), rel_tol=1e-9, abs_tol=1e-12)


def test_learns_words_and_locates_sentences(spark):
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    docs = []
    for i in range(400):
        lines = [" ".join(rng.choice(words, 6)) for _ in range(rng.integers(1, 8))]
        toxic = int(i % 5 == 0)
        if toxic:
            lines[rng.integers(len(lines))] += rng.choice([" Scoundrel", " VILLAIN!"])
        docs.append((i, ". ".join(lines), toxic))
    rows = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = mil.fit(rows.drop("toxic"), rows.select("doc_id", "toxic"), F.col("id") < 300)
    got = mil.score(rows, model).join(rows, "doc_id").collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in got if r["doc_id"] >= 300)
    for r in got:
        found = [r["text"].encode()[s["begin"] : s["end"]].decode().lower() for s in r["offending"]]
        assert bool(found) == bool(r["toxic"])
        assert all("scoundrel" in f or "villain" in f for f in found)


def test_held_out_rows_of_the_query(spark):
    rows = op8_toxicity_mil(spark, SF.replace("0.001", "0.1"))
    labels = table(spark, SF.replace("0.001", "0.1"), "labels")
    got = rows.join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    toxic = [r["predicted"] for r in held if r["toxic"] == 1]
    clean = [r["predicted"] for r in held if r["toxic"] == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


def test_odd_rows(spark, odd, empty):
    model = model_of(["idiot", "beta"])
    got = mil.score(odd.withColumnRenamed("ids", "score"), model).collect()
    want = sorted((str(i), plain_score(t, model)) for i, t, *_ in odd_rows())
    assert np.allclose([s for _, s in want], [s for _, s in sorted((str(r["doc_id"]), r["score"]) for r in got)])
    assert mil.score(empty, model).count() == 0
    labels = spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    nothing = mil.fit(odd, labels)
    assert len(nothing.features) == 0
    assert max(r["score"] for r in mil.score(odd.filter("text IS NULL"), nothing).collect()) == 0.0
    both = spark.createDataFrame([(3, 1), (4, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    assert len(mil.fit(odd, both).features) == 0
