import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.config import FEATURES, FeatureConfig
from tracelake.functions.expressions import NORMAL_CLIP, normal_quantile
from tracelake.operators import features, quantiles, statistics
from tracelake.schemas import require_columns

CFG = FeatureConfig()


def column(spark, values, name="x"):
    rows = [(str(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"job_id string, {name} double")


def quantile_list(spark, values, n, cap=True):
    rows = quantiles.quantile_table(column(spark, values), {"x": n}, cap).orderBy("i").collect()
    return [r["q"] for r in rows]


def test_normal_quantile():
    probs = [1e-7, 1e-5, 0.001, 0.02, 0.075, 0.3, 0.5, 0.7, 0.95, 0.999, 1 - 1e-7]
    got = normal_quantile(np.array(probs))
    for p, z in zip(probs, got):
        want = NormalDist().inv_cdf(p)
        assert z == pytest.approx(max(-NORMAL_CLIP, min(NORMAL_CLIP, want)), abs=1e-13)


def test_quantiles_golden(spark):
    assert quantile_list(spark, [1, 2, 2, 4], 4) == [1, 2, 2, 4]
    assert quantile_list(spark, [0, 1, 2, 3, 10], 3) == [0, 2, 10]
    assert quantile_list(spark, [5], 10) == [5]
    assert quantile_list(spark, [5], 3, cap=False) == [5, 5, 5]
    assert quantile_list(spark, [1, 2], 3, cap=False) == [1, 1.5, 2]


@pytest.mark.parametrize("seed,size,n,top", [(1, 997, 200, 50), (2, 50, 1000, 10), (3, 2000, 7, 10**6), (4, 300, 300, 3)])
def test_quantiles_brute_force(spark, seed, size, n, top):
    import random

    rng = random.Random(seed)
    values = [float(rng.randint(0, top)) for _ in range(size)]
    got = quantile_list(spark, values, n)
    s, m = sorted(values), min(n, size)
    want = []
    for i in range(m):
        lo, rest = divmod(i * (size - 1), m - 1)
        hi = s[min(lo + 1, size - 1)]
        want.append(s[lo] + rest / (m - 1) * (hi - s[lo]))
    assert got == pytest.approx(want, abs=1e-9)


def scores(spark, values, n):
    df = column(spark, values)
    model = quantiles.QuantileNormal.fit(df, {"x": n})
    return {r["x"]: r["z"] for r in model.transform(df, "x", "z").collect()}


def test_quantile_normal_golden(spark):
    z = scores(spark, [1, 2, 2, 4], 4)
    assert z[1.0] == -NORMAL_CLIP and z[4.0] == NORMAL_CLIP and z[2.0] == pytest.approx(0.0, abs=1e-12)
    z = scores(spark, [0, 1, 2, 3, 10], 3)
    assert z[1.0] == pytest.approx(NormalDist().inv_cdf(0.25))
    assert z[3.0] == pytest.approx(NormalDist().inv_cdf(0.5625))
    assert scores(spark, [7, 7, 7], 3) == {7.0: -NORMAL_CLIP}
    assert scores(spark, [None, 1, 2], 2)[None] is None


def test_medians(spark):
    df = column(spark, [5, 1, 3, 2])
    assert quantiles.exact_medians(df, ["x"]).first()["median"] == 2.5


def one(spark, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df


def test_cyclical(spark):
    df = one(spark, t=1640995200 + 6 * 3600)
    r = df.select(*[c.alias(n) for n, c in features.cyclical_columns(F.col("t"), CFG).items()]).first()
    assert r["hour_sin"] == pytest.approx(1.0)
    assert r["dow_sin"] == pytest.approx(math.sin(2 * math.pi * 5 / 7))
    assert (r["dom_sin"], r["dom_cos"]) == (0.0, 1.0)
    bad = spark.createDataFrame([("oops",), ("99999999999999",)], "t string")
    for r in bad.select(*[c.alias(n) for n, c in features.cyclical_columns(F.col("t"), CFG).items()]).collect():
        assert set(r) == {None}


def test_cyclical_ignores_session_time_zone(spark):
    df = one(spark, t=1640995200 + 6 * 3600)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        r = df.select(features.cyclical_columns(F.col("t"), CFG)["hour_sin"]).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r[0] == pytest.approx(1.0)


def test_tiers_nodes_memory(spark):
    df = spark.createDataFrame([(10999.0,), (11000.0,), (19999.0,), (20000.0,)], "p double")
    assert [r[0] for r in df.select(features.priority_tier(F.col("p"), CFG.tier_thresholds)).collect()] == [0, 1, 1, 2]
    df = spark.createDataFrame([(1,), (4,)], "nodes_req int")
    got = df.select(*features.node_columns(CFG).values()).collect()
    assert [tuple(r) for r in got] == [(1, 0.0), (0, 0.25)]
    df = spark.createDataFrame([(1e9,), (5.0,), (None,)], "mem_req double")
    assert [tuple(r) for r in df.select(*features.memory_columns(CFG).values()).collect()] == [
        (1, None), (0, 5.0), (0, None),
    ]


def _jobs(spark, n=40):
    rows = [
        (str(i), i % 7 + 1, 2e9 if i % 5 == 0 else float(i), 500.0 * (i + 1), (1, 3, 4, 5, 6, 7, 11)[i % 7],
         ("LLSUB:BATCH", "LLSUB:INTERACTIVE", "LLMAPREDUCE:MAP", "OTHER", "UNKNOWN")[i % 5],
         1640995200 + 3600 * i, f"t/{i}", i % 3 + 1, 300.0 + i, 3000 + i)
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "job_id string, cpus_req long, mem_req double, priority double, state int, job_type string, "
        "time_start long, file_path string, nodes_req int, duration_sec double, length long",
    )


def test_feature_table(spark):
    out = features.build_features(_jobs(spark), CFG)
    require_columns(out)
    assert not set(features.RAW_COLUMNS) & set(out.columns)
    rows = {r["job_id"]: r for r in out.collect()}
    unknown = rows["4"]
    assert [unknown[c] for c in FEATURES if c.startswith("type_")] == [0, 0, 0, 0]
    assert rows["5"]["state_other"] == 1 and rows["0"]["state_other"] == 1
    assert rows["0"]["mem_unlimited"] == 1 and rows["0"]["mem_req_scaled"] == 0.0
    with pytest.raises(KeyError, match="ptier_0"):
        require_columns(out.drop("ptier_0"))


def test_filter_after_features_keeps_the_plan_small(spark):
    """A filter on scaled columns must not multiply the transform's expressions."""
    from tracelake.operators.split import usable_jobs

    plan = usable_jobs(features.build_features(_jobs(spark), CFG))
    assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 400_000
    assert plan.count() == 40


def test_fit_on_subset(spark):
    jobs = _jobs(spark)
    model = features.fit_scaling(jobs, CFG, fit_on=jobs.filter("cast(job_id as int) < 10"))
    assert len(model.quantiles["duration_log"]) == 10


def test_join_and_dedup(spark):
    index = spark.createDataFrame(
        [("1", "p", 2, 5.0, 9), ("1", "p", 2, 5.0, 9), ("9", "q", 1, 6.0, 8)],
        "job_id string, file_path string, nodes_used int, duration_sec double, length long",
    )
    used = features.select_index(index)
    assert used.count() == 2 and "nodes_req" in used.columns
    joined = features.join_jobs(_jobs(spark).select("job_id", "cpus_req"), used)
    assert sorted(r["job_id"] for r in joined.collect()) == ["1", "9"]
    with pytest.raises(ValueError):
        features.require_rows(joined.limit(0))


def test_histogram(spark):
    got = statistics.histograms(column(spark, [0, 0.5, 1, 1, None]), bins=4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 0, 1, 2]
    flat = statistics.histograms(column(spark, [3, 3]), bins=2).orderBy("bin").collect()
    assert [(r["left_edge"], r["n"]) for r in flat] == [(2.5, 0), (3.0, 2)]


def test_correlation(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.normal(1e6, 1.0, 500)
    b = a * 2 + rng.normal(0, 1, 500)
    rows = [(float(x), float(y) if i % 3 else None, 4.0) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    got = {(r["col_a"], r["col_b"]): r["r"] for r in statistics.correlations(df).collect()}
    keep = np.arange(500) % 3 > 0
    assert got[("b", "a")] == pytest.approx(np.corrcoef(a[keep], b[keep])[0, 1], abs=1e-9)
    assert got[("a", "a")] == pytest.approx(1.0)
    assert got[("c", "c")] is None and got[("c", "a")] is None
    assert len(got) == 6
