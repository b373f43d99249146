import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.config import CHANNEL_NAMES, FEATURES, NormConfig, WindowConfig
from tracelake.operators import epochs, evaluate, normalize, rowid, scoring, split, windows

WIN = WindowConfig(w_ctx=4, w_pred=2, stride=2, bin_sec=0.103)
NORM = "job_id string, k long, z0 float, z1 float, z2 float, z3 float"


def job_table(spark, sizes):
    rows, n = [], 0
    for stratum, size in sizes.items():
        for _ in range(size):
            rows.append((str(n), stratum))
            n += 1
    return spark.createDataFrame(rows, "job_id string, kind string")


def test_random_split_is_exact_and_disjoint(spark):
    jobs = job_table(spark, {"a": 150})
    out = split.random_split(jobs, 0.1, 42)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 15, "train": 135}
    assert out.select("job_id").distinct().count() == 150
    again = split.random_split(jobs.repartition(7), 0.1, 42)
    pick = lambda d: {r["job_id"] for r in d.filter("split = 'test'").collect()}
    assert pick(out) == pick(again) != pick(split.random_split(jobs, 0.1, 7))


def test_stratified_split_sizes(spark):
    jobs = job_table(spark, {"a": 3, "b": 25, "c": 4, "d": 35, "e": 1})
    out = split.stratified_split(jobs, ("kind",), 0.1, 42)
    got = {r["stratum"]: r["n"] for r in out.filter("split = 'test'").groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "d": 4, "e": 1}
    assert tuple(split.split_coverage(out).first()) == (5, 4, 5)


def test_subsample_quota(spark):
    jobs = job_table(spark, {"a": 2, "b": 10, "c": 10})
    assert split.stratified_subsample(jobs, 10, ("kind",), 42).count() == 8
    assert split.stratified_subsample(jobs, 2, ("kind",), 42).count() == 2
    assert split.stratified_subsample(jobs, 30, ("kind",), 42).count() == 22
    assert split.stratified_subsample(jobs, 5, (), 42).count() == 5


def test_sample_and_random(spark):
    jobs = job_table(spark, {"a": 11})
    assert split.sample_jobs(jobs, 0.5, 42).count() == 5
    assert split.sample_jobs(jobs, 0.01, 42).count() == 1
    assert split.sample_jobs(jobs, None, 42).count() == 11
    assert split.random_jobs(jobs, 3, 42).count() == 3


def test_row_ids_are_dense(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    got = rowid.with_ordered_row_id(df, "key", buckets=5).collect()
    assert [r["key"] for r in sorted(got, key=lambda r: r["row_id"])] == sorted(str(i) for i in range(1000))
    assert {r["n_rows"] for r in got} == {1000}
    assert rowid.with_ordered_row_id(df.limit(0), "key").count() == 0
    hashed = rowid.with_row_id(df, F.md5("key"), ("key",), digits=1).collect()
    assert sorted(r["row_id"] for r in hashed) == list(range(1000))


def test_finite_filter(spark):
    rows = [(1.0, 5), (float("nan"), 5), (float("inf"), 5), (None, 5), (1.0, 0), (1.0, None)]
    df = spark.createDataFrame(rows, "x double, length long")
    assert split.usable_jobs(df, ("x", "length")).count() == 1
    assert tuple(split.drop_counts(df, ("x", "length")).first()) == (6, 4, 1, 1)


def trace_table(spark, values):
    rows = [("1", k, 0.0, 75.0, 0.0, float(v), float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "job_id string, k long, timestamp double, " + ", ".join(f"{c} float" for c in CHANNEL_NAMES)
    )


def test_norm_fit(spark):
    one = spark.createDataFrame([("1",)], "job_id string")
    fit = lambda v: {r["channel"]: r for r in normalize.fit_norm(trace_table(spark, v), one, NormConfig()).collect()}
    r = fit([0, math.e - 1])["power_draw_W"]
    assert (r["log_mean"], r["log_std"]) == pytest.approx((0.5, 0.5), abs=1e-7)
    assert fit([3, 3])["memory_used_MiB"]["log_std"] == pytest.approx(1e-6, rel=0.5)
    assert (fit([1])["gpu_used_pct"]["log_mean"], fit([1])["gpu_used_pct"]["log_std"]) == (0.0, 1.0)
    other = spark.createDataFrame([("2",)], "job_id string")
    with pytest.raises(Exception, match="no data for channel"):
        normalize.fit_norm(trace_table(spark, [1]), other, NormConfig()).collect()


def _stats(spark, **kw):
    rows = [("gpu_used_pct", "linear_pct", 0.0, 1.0), ("memory_used_pct", "linear_pct", 0.0, 1.0),
            ("memory_used_MiB", "log1p_zscore", 0.0, kw.get("s2", 1.0)), ("power_draw_W", "log1p_zscore", 2.0, 0.5)]
    return spark.createDataFrame(rows, "channel string, norm string, log_mean double, log_std double")


def test_normalize_and_back(spark):
    stats = normalize.ChannelStats.from_table(_stats(spark, s2=0.25))
    out = normalize.normalize(trace_table(spark, [0, 9, 19]), stats, NormConfig()).orderBy("k")
    rows = out.select("*", stats.denormalized(F.col("z3")).alias("w")).collect()
    assert [r["z0"] for r in rows] == [0.5] * 3 and [r["z1"] for r in rows] == [-1.0] * 3
    assert rows[2]["z2"] == 10.0  # log1p(19) / 0.25 is above the clip
    assert [r["w"] for r in rows] == pytest.approx([0, 9, 19], abs=1e-4)
    bad = _stats(spark).withColumn("norm", F.lit("minmax"))
    with pytest.raises(ValueError, match="unknown_norm:minmax"):
        normalize.ChannelStats.from_table(bad)


def norm_table(spark, n, job="1"):
    rows = [(job, k, k + 1.0, 10.0 + k, 20.0 + k, k + 1.0) for k in range(n)]
    return spark.createDataFrame(rows, NORM)


def test_pack(spark):
    index = spark.createDataFrame([("1",)], "job_id string")
    norm = norm_table(spark, 3).unionByName(norm_table(spark, 2, "2"))
    r = normalize.pack(norm.orderBy(F.col("k").desc()), index, 3).collect()
    assert len(r) == 1 and r[0]["length"] == 3
    assert r[0]["ch"] == [[1, 2, 3], [10, 11, 12], [20, 21, 22], [1, 2, 3]]
    with pytest.raises(Exception, match="duration bound"):
        normalize.pack(norm, index, 2).collect()
    jobs = spark.createDataFrame([("1", 99), ("3", 5)], "job_id string, length long")
    assert [tuple(r) for r in normalize.attach_lengths(jobs, norm).collect()] == [("1", 3)]


def test_chunk_index(spark):
    jobs = spark.createDataFrame([("a", 1), ("b", 8192), ("c", 8193), ("d", 16385)], "job_id string, length long")
    got = windows.chunk_index(jobs, 8192).groupBy("job_id").count().orderBy("job_id").collect()
    assert [r["count"] for r in got] == [1, 1, 2, 3]


def cond_table(spark, jobs=("1",)):
    return spark.createDataFrame([(j, *[float(i) for i in range(24)]) for j in jobs], ["job_id", *FEATURES])


def test_windows_golden(spark):
    norm = norm_table(spark, 5)
    chunks = windows.chunk_index(spark.createDataFrame([("1", 5)], "job_id string, length long"), 2)
    out = windows.training_windows(chunks, norm, cond_table(spark), WIN).orderBy("chunk_idx").collect()
    assert [r["ctx"][3] for r in out] == [[0, 0, 0, 0], [0, 0, 1, 2], [1, 2, 3, 4]]
    assert [r["target"] for r in out] == [[1, 2], [3, 4], [5, 0]]
    assert [r["pred_mask"] for r in out] == [[1, 1], [1, 1], [1, 0]]
    assert [len(r["future_aux"]) for r in out] == [3, 3, 3]
    assert out[2]["future_aux"][1] == [14, 0]
    assert out[0]["cond"] == [float(i) for i in range(24)]


@pytest.mark.parametrize("w_ctx,w_pred,stride,n", [(5, 3, 2, 11), (1, 4, 3, 7), (6, 2, 5, 13), (4, 2, 2, 1)])
def test_windows_general_geometry(spark, w_ctx, w_pred, stride, n):
    cfg = WindowConfig(w_ctx=w_ctx, w_pred=w_pred, stride=stride)
    got = windows.cut_windows(windows.segments(norm_table(spark, n), stride), cfg).orderBy("chunk_idx").collect()
    x = np.arange(1, n + 1, dtype=float)
    assert len(got) == max(1, -(-n // stride))
    for r in got:
        s = r["chunk_idx"] * stride
        ctx, fut = np.zeros(w_ctx), np.zeros(w_pred)
        have = x[max(0, s - w_ctx):s]
        if len(have):
            ctx[-len(have):] = have
        real = x[s:s + w_pred]
        fut[:len(real)] = real
        assert r["ctx"][3] == list(ctx) and r["target"] == list(fut)
        assert sum(r["pred_mask"]) == len(real)


def test_epoch_plan_golden(spark):
    chunks = spark.createDataFrame([("j", i) for i in range(11)], "job_id string, chunk_idx long")
    plan = epochs.epoch_plan(chunks, 0, world=2, batch=2).orderBy("i").collect()
    assert [r["i"] for r in plan] == list(range(8))
    assert [(r["rank"], r["step"]) for r in plan] == [(i % 2, i // 2 // 2) for i in range(8)]
    other = epochs.epoch_plan(chunks, 1, world=2, batch=2).orderBy("i").collect()
    assert [r["chunk_idx"] for r in plan] != [r["chunk_idx"] for r in other]
    capped = epochs.epoch_plan(chunks, 0, world=2, batch=2, max_steps=1)
    assert epochs.batch_layout(capped).orderBy("rank").collect() == [(0, 0, 2), (1, 0, 2)]
    norm = norm_table(spark, 21, "j")
    w = windows.cut_windows(windows.segments(norm, 2), WIN)
    order = epochs.epoch_plan(chunks, 0, 2, 2)
    batches = epochs.assemble_batches(order, w)
    target = {r["chunk_idx"]: r["target"] for r in w.collect()}
    want = {(r["rank"], r["step"], r["i"] // 2 % 2): target[r["chunk_idx"]] for r in order.collect()}
    assert {(r["rank"], r["step"], r["pos"]): r["target"] for r in batches.collect()} == want and len(want) == 8
    # Every partition reads its batches one after another, in order.
    rows = batches.withColumn("part", F.spark_partition_id()).collect()
    for part in {r["part"] for r in rows}:
        own = [(r["rank"], r["step"], r["pos"]) for r in rows if r["part"] == part]
        assert own == sorted(own)


def test_window_counts(spark):
    cfg = WindowConfig(max_windows=None)
    jobs = spark.createDataFrame([("a", 9000, 900.0), ("b", 8193, None), ("c", 5, 0.0)], "job_id string, length long, duration_sec double")
    got = {r["job_id"]: r["max_windows"] for r in scoring.windows_per_job(jobs, cfg).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}
    assert {r["max_windows"] for r in scoring.windows_per_job(jobs, WindowConfig()).collect()} == {25}
    plan = spark.createDataFrame([("a", 5, 2), ("b", 0, 1)], "job_id string, length long, max_windows long")
    rows = [tuple(r) for r in scoring.score_plan(plan, 2).orderBy("w").collect()]
    assert rows == [("a", 0, 0, 2), ("a", 1, 2, 2)]


def _score(spark, norm, predictor, jobs=("1",), cap=25):
    lengths = norm.groupBy("job_id").agg(F.count("*").alias("length")).withColumn("max_windows", F.lit(cap).cast("long"))
    plan = scoring.score_plan(lengths, WIN.w_pred)
    return scoring.score_jobs(norm, plan, windows.conditioning(cond_table(spark, jobs)), predictor, WIN)


def test_carry_golden(spark):
    out = scoring.unpack_scores(_score(spark, norm_table(spark, 5), scoring.carry_predictor)).orderBy("k").collect()
    assert [r["gen_z"] for r in out] == [0.5, 1.0, 2.0, 2.5, 3.75]
    assert [r["real_z"] for r in out] == [1, 2, 3, 4, 5]
    capped = scoring.unpack_scores(_score(spark, norm_table(spark, 5), scoring.carry_predictor, cap=1))
    assert capped.count() == 2


def test_scoring_failures_are_rows(spark):
    norm = norm_table(spark, 5).unionByName(norm_table(spark, 4, "2")).unionByName(norm_table(spark, 4, "3"))

    def picky(ctx, aux, cond):
        if aux[0, 0] == 5.0:
            raise RuntimeError("boom")
        return aux[0]

    scored = _score(spark, norm, picky, jobs=("1", "2"))
    failures = {r["job_id"]: (r["w"], r["error"]) for r in scoring.score_failures(scored).collect()}
    assert failures["1"] == (2, "RuntimeError: boom")
    assert failures["3"][0] == 0 and "conditioning" in failures["3"][1]
    assert {r["job_id"] for r in scoring.unpack_scores(scored).collect()} == {"2"}


def test_context_holds_generated_power(spark):
    seen = []

    def spy(ctx, aux, cond):
        return aux[0] + 100 * ctx[3, -1] + ctx[0, -1]

    out = scoring.unpack_scores(_score(spark, norm_table(spark, 4), spy)).orderBy("k").collect()
    assert [r["gen_z"] for r in out] == [1.0, 2.0, 3.0 + 200 + 2, 4.0 + 200 + 2] and not seen


def pairs(spark, real, fake, job="1", names=("real_w", "gen_w")):
    rows = [(job, k, float(a), float(b)) for k, (a, b) in enumerate(zip(real, fake))]
    return spark.createDataFrame(rows, f"job_id string, k long, {names[0]} double, {names[1]} double")


def test_metrics_golden(spark):
    r = evaluate.trace_metrics(pairs(spark, [1, 2, 3], [2, 2, 4]), 0.103).first()
    assert (r["pearson_r"], r["rmse"], r["mae"]) == pytest.approx((0.866025, 0.816497, 0.666667), abs=1e-6)
    flat = evaluate.trace_metrics(pairs(spark, [1, 2, 3], [2, 2, 2]), 0.103).first()
    assert flat["pearson_r"] is None and flat["mae"] == pytest.approx(2 / 3)
    jobs = spark.createDataFrame([("1",), ("2",)], "job_id string")
    empty = evaluate.trace_metrics(pairs(spark, [1, 2], [2, 1]), 0.103, jobs).filter("job_id = '2'").first()
    assert (empty["pearson_r"], empty["rmse"], empty["length"]) == (None, None, 0)


def test_attach_and_headline(spark):
    jobs = spark.createDataFrame([("1",), ("2",), ("3",)], "job_id string")
    stored = spark.createDataFrame([("1", 0.25), ("2", None)], "job_id string, pearson_r double")
    z = ("real_z", "gen_z")
    got = {r["job_id"]: r["pearson_r"] for r in evaluate.attach_pearson(
        jobs, stored, pairs(spark, [1, 2, 3], [2, 2, 4], "2", z).unionByName(pairs(spark, [1, 2], [9, 1], "1", z))).collect()}
    assert got["1"] == 0.25 and got["2"] == pytest.approx(0.866025, abs=1e-6) and got["3"] is None
    summary = spark.createDataFrame([("1", 0.5, 1.0, 1.0), ("2", None, 2.0, 3.0), ("3", 0.1, 6.0, 2.0)], "job_id string, pearson_r double, rmse double, mae double")
    h = evaluate.headline(summary).first()
    assert (h["pearson_r_mean"], h["pearson_r_median"], h["share_above"]) == pytest.approx((0.3, 0.3, 0.5))
    assert (h["rmse_mean"], h["rmse_median"], h["mae_median"], h["n_jobs"]) == (3.0, 2.0, 2.0, 3)
    assert [r["job_id"] for r in evaluate.best_jobs(summary, 1).collect()] == ["1"]
    assert [r["job_id"] for r in evaluate.worst_jobs(summary, 5).collect()] == ["3", "1"]


def test_captions_default_to_one_node(spark):
    w = pairs(spark, [1, 3], [2, 2])
    r = evaluate.trace_captions(w, spark.createDataFrame([("1",)], "job_id string"), 0.103).first()
    assert (r["nodes_req"], r["real_mean"], r["real_max"], r["gen_max"]) == (1, 2.0, 3.0, 2.0)


def test_masked_loss_golden(spark):
    rows = [("1", 0, 1.0, 0.0, 1.0), ("1", 0, 2.0, 4.0, 1.0), ("1", 0, 9.0, 0.0, 0.0), ("1", 1, 1.0, 1.0, 1.0)]
    bins = spark.createDataFrame(rows, "job_id string, chunk_idx long, pred double, target double, mask double")
    losses = evaluate.window_losses(bins)
    assert tuple(evaluate.masked_loss(losses, 20.0).first()) == (2, 0, 1.25)
    assert tuple(evaluate.masked_loss(losses, 2.0).first()) == (2, 1, 0.0)
    broken = losses.withColumn("loss", F.lit(float("nan")))
    assert tuple(evaluate.masked_loss(broken, 2.0).first()) == (2, 2, 0.0)
