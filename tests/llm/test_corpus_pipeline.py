import numpy as np
import pytest

import corpus_pipeline as pipeline
from tracelake.llm import rule_forest, swap_packing, toxicity_mil
from tracelake.llm.common import table, written

from .conftest import SF, odd_rows
from .test_minhash_hamming import plain_classes
from .test_suffix_buckets import plain as plain_repeats
from .test_swap_packing import check_layout
from .test_swap_packing import plain as plain_pieces


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What every stage returns, from the one before."""
    out = [documents]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality(spark, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    stats = rule_forest.statistics(stages[0])
    forests = rule_forest.fit(stats, table(spark, SF, "labels"))
    want = {r["doc_id"] for r in rule_forest.score(stats, forests).filter("kept").collect()}
    assert after == {i: before[i] for i in want}
    bad = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 0").collect()}
    assert len(bad & set(after)) <= 1 and len(after) > 0.7 * len(before)


def test_toxicity(spark, stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    gone = set(before) - set(after)
    assert all(after[i] == before[i] for i in after)
    assert sum(labels.get(i) == 0 for i in gone) <= 1
    assert sum(labels.get(i) == 1 for i in gone) >= 0.6 * sum(labels.get(i) == 1 for i in before)


def test_near_duplicates(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    classes = plain_classes(before.items(), 80)
    assert after == {i: t for i, t in before.items() if classes[i][1] == i}


def test_repeated_strings(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    rows = sorted(before.items())
    assert set(after) == set(before)
    for (i, text), (_, removed, _, _) in zip(rows, plain_repeats(rows, pipeline.PASSAGE_BYTES)):
        left = len(text.encode()) - removed
        assert left - 6 * (removed > 0) <= len(after[i].encode()) <= left
    for r in stages[4].collect():
        assert r["n_chars"] == len(r["text"])


def test_packing(spark, stages):
    texts, rows = by_id(stages[4]), stages[5].collect()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == sorted((i, k, *p) for i, t in texts.items() for k, p in enumerate(plain_pieces(t)))
    lengths = np.array([r["length"] for r in rows])
    assert check_layout(rows) <= swap_packing.lower_bound(lengths, 2048) + 1
    assert pipeline.run(spark, SF).count() == len(rows)


def test_odd_rows_and_empty_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (8, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for df in (odd.withColumnRenamed("id", "key"), empty):
        left = df
        for name, stage in pipeline.STAGES[:-1]:
            left = written(stage(spark, left, str(tmp_path)), "odd")
            assert left.columns == df.columns
        pieces = pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count()
        assert (pieces > 0) == (df is not empty)


def test_columns_of_scores_equal_the_tables(spark, odd, documents):
    model = toxicity_mil.Model(np.zeros(0, np.uint64), np.zeros(0), -3.0)
    for df in (odd, documents):
        want = sorted(r["score"] for r in toxicity_mil.score(df, model).collect())
        got = df.select(toxicity_mil.score_text(df["text"], model).alias("s")).collect()
        assert np.allclose(want, sorted(r["s"] for r in got))
    assert odd.filter(rule_forest.keeps(odd["text"], {})).count() == sum(
        len((t or "").split()) >= 50 for _, t, *_ in odd_rows()
    )
