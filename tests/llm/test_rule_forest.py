import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import rule_forest as rules
from tracelake.llm.common import table
from tracelake.llm.queries import op6_rule_forest

from .conftest import SF, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    for line in lines:
        dup += line in seen
        seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside[i : i + 3] = [True] * 3
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(inside))


def test_counts_equal_plain_counts(spark, texts):
    got = op6_rule_forest(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_verdict_on_labelled_rows(spark):
    sf = SF.replace("0.001", "0.1")
    rows = op6_rule_forest(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("NOT base_failed")
    kept = {r["quality"]: r["kept"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.998 and kept[0] < 0.02


def plain_path(forest, tree, x, node=1):
    f = forest.feature[tree, node]
    if f < 0:
        return forest.path[tree, node]
    return plain_path(forest, tree, x, 2 * node + (x[f] > forest.split[tree, node]))


def test_anomaly_equals_a_walk_through_the_trees():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(500, 3)), [[9, 9, 9]]])
    forest = rules.grow(x, rules.Limits(trees=20))
    got = rules.anomaly(forest, x)
    for k in (0, 17, 500):
        mean = np.mean([plain_path(forest, t, x[k]) for t in range(20)])
        assert np.isclose(got[k], 2 ** (-mean / forest.norm))
    assert got.argmax() == 500


def test_threshold():
    limits = rules.Limits(steps=10)
    tally = np.zeros((2, 11), np.int64)
    assert rules.threshold(tally, limits) == 2.0
    tally[1, 2] = 100
    assert rules.threshold(tally, limits) == 2.0
    tally[0, 8] = 30
    assert rules.threshold(tally, limits) == 0.55  # between steps 3 and 8
    tally[1, 9] = 2  # two good rows outweigh thirty bad ones
    assert rules.threshold(tally, limits) == 2.0


def test_odd_rows(spark, odd, empty):
    odd = odd.withColumnRenamed("ids", "n_words")
    got = rules.statistics(odd).collect()
    want = sorted((str(i), *plain(t)) for i, t, *_ in odd_rows())
    assert sorted((str(r[0]), *tuple(r)[1:6]) for r in got) == want
    labels = spark.createDataFrame([(5, None), (None, 1), (77, 0)], "doc_id long, quality int")
    stats = rules.statistics(odd)
    kept = rules.score(stats, rules.fit(stats, labels)).collect()
    assert len(kept) == len(want)
    assert all(r["kept"] != r["base_failed"] for r in kept)
    none = rules.statistics(empty)
    assert rules.fit(none, labels) == {}
    assert rules.score(none, {}).count() == 0
