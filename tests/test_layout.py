"""Parts from rows, cuts from sketches, moments that merge, selection without a sort, balanced tasks, batch files."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracelake.config import CHANNEL_NAMES, FEATURES, NormConfig, WindowConfig
from tracelake.operators import epochs, layout, moments, normalize, rowid, scoring, selection, windows
from tracelake.functions.expressions import seeded_hash

WIN = WindowConfig(w_ctx=4, w_pred=2, stride=2, bin_sec=0.103)
NORM = "job_id string, k long, z0 float, z1 float, z2 float, z3 float"


def test_parts_follow_from_rows(spark):
    assert [layout.parts_of(n, 10) for n in (0, 1, 10, 11, 95)] == [1, 1, 1, 2, 10]
    assert layout.tasks_of(spark, 10**10, 10**6) == 10**4
    rows = spark.range(50_000, numPartitions=7).select(
        F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"), F.sqrt("id").alias("v")
    )
    sketched = layout.sketches(rows.union(spark.createDataFrame([("c", None), ("d", 3.0)], "g string, v double")), "v", ("g",))
    cuts = layout.cuts(sketched, 1_000, "g")
    assert len(cuts["a"]) == 39 and len(cuts["b"]) == 9 and cuts["d"] == [] and "c" not in cuts
    sizes = [rows.filter(f"g = 'a' AND v >= {low} AND v < {high}").count() for low, high in zip(cuts["a"][:5], cuts["a"][1:6])]
    assert all(800 < n < 1_200 for n in sizes)


def test_row_numbers_with_buckets_from_rows(spark, monkeypatch):
    monkeypatch.setattr(rowid, "BUCKET_ROWS", 40)
    df = spark.range(1_000).select(F.lpad((F.col("id") * 7 % 1_000).cast("string"), 4, "0").alias("key"))
    got = {r["key"]: r["row_id"] for r in rowid.with_ordered_row_id(df, "key").collect()}
    assert got == {f"{k:04d}": k for k in range(1_000)}


def test_moments_of_a_large_mean_with_a_tiny_spread(spark):
    rng, rows = random.Random(2), []
    for job in range(40):
        rows += [(str(job), 1e8 + 1e-3 * rng.random(), 5.0 * rng.random()) for _ in range(rng.choice([1, 3, 200]))]
    rows.append(("none", None, None))
    df = spark.createDataFrame(rows, "job string, x double, y double").repartition(6)
    columns = {"x": F.col("x"), "y": F.col("y")}
    got = moments.merged(moments.per_group(df, ("job",), columns, [("x", "y")]), columns, [("x", "y")])
    xs, ys = zip(*[(x, y) for _, x, y in rows[:-1]])
    n, mx, my = len(xs), math.fsum(xs) / len(xs), math.fsum(ys) / len(ys)
    assert got.n == {"x": n, "y": n}
    assert got.mean["x"] == pytest.approx(mx, rel=1e-15) and got.mean["y"] == pytest.approx(my, rel=1e-12)
    assert got.m2["x"] == pytest.approx(math.fsum((x - mx) ** 2 for x in xs), rel=1e-4)
    assert got.m2["y"] == pytest.approx(math.fsum((y - my) ** 2 for y in ys), rel=1e-9)
    # Differences from a mean of 1e8 have seven digits; sums of squares would leave none.
    assert got.c["x", "y"] == pytest.approx(math.fsum((x - mx) * (y - my) for x, y in zip(xs, ys)), rel=1e-3, abs=1e-5)


def test_norm_fit_of_a_tiny_spread(spark):
    values = [1e6 * (1 + 1e-7 * (k % 3)) for k in range(300)]
    rows = [(str(k % 7), k, 0.0, 1.0, 1.0, 1.0, v) for k, v in enumerate(values)]
    schema = "job_id string, k long, timestamp double, " + ", ".join(f"{c} double" for c in CHANNEL_NAMES)
    jobs = spark.createDataFrame([(str(k),) for k in range(7)], "job_id string")
    fit = normalize.fit_norm(spark.createDataFrame(rows, schema), jobs, replace(NormConfig(), min_std=1e-12))
    got = {r["channel"]: r for r in fit.collect()}[CHANNEL_NAMES[3]]
    logs = [math.log1p(v) for v in values]
    mean = math.fsum(logs) / 300
    assert got["log_mean"] == pytest.approx(mean, abs=1e-13)
    assert got["log_std"] == pytest.approx(math.sqrt(math.fsum((x - mean) ** 2 for x in logs) / 300), rel=1e-6)


@pytest.mark.parametrize("digits", [1, 3])
def test_first_rows_equal_a_sort(spark, digits):
    """Same rows as sorting each group, for none, some and all of a group."""
    rows = [(f"j{k}", "abc"[min(2, k % 9)]) for k in range(600)]
    df, key = spark.createDataFrame(rows, "job_id string, g string"), seeded_hash(7, F.col("job_id"))
    place = {r["job_id"]: r["h"] for r in df.select("job_id", key.alias("h")).collect()}
    for wanted, count in ((lambda n: F.lit(0), lambda n: 0), (lambda n: F.floor(n / 3), lambda n: n // 3), (lambda n: n, lambda n: n)):
        marked = selection.mark_first(df, key, ("job_id",), wanted, ("g",), digits=digits)
        want = set()
        for g in "abc":
            own = sorted((place[j], j) for j, h in rows if h == g)
            want |= {j for _, j in own[: count(len(own))]}
        assert {r["job_id"] for r in marked.filter("selected").collect()} == want
    some = selection.mark_first(df, key, ("job_id",), lambda n: F.lit(41), digits=digits)
    assert {r["job_id"] for r in some.filter("selected").collect()} == {j for _, j in sorted((h, j) for j, h in place.items())[:41]}
    assert some.columns == ["job_id", "g", "selected"]
    assert selection.mark_first(df.limit(0), key, ("job_id",), lambda n: n).count() == 0


def test_jobs_are_dealt_by_their_windows(spark):
    """On skewed lengths the longest task stays near the mean."""
    rng = random.Random(3)
    sizes = {f"j{k}": max(1, int(rng.paretovariate(1.1))) % 140 + 1 for k in range(3_000)}
    plan = spark.createDataFrame([(j,) for j, n in sizes.items() for _ in range(n)], "job_id string")
    loads = {}
    for r in scoring.deal_jobs(plan, 8).collect():
        loads[r["task"]] = loads.get(r["task"], 0) + sizes[r["job_id"]]
    assert set(loads) == set(range(8)) and max(loads.values()) <= 1.2 * sum(loads.values()) / 8


def traces(spark, lengths):
    rows = [(j, k, *(float(10 * k + c) for c in range(4))) for j, n in lengths.items() for k in range(n)]
    return spark.createDataFrame(rows, NORM)


def job_rows(spark, jobs):
    return spark.createDataFrame([(j, *([0.5] * len(FEATURES))) for j in jobs], "job_id string, " + ", ".join(f"{c} double" for c in FEATURES))


def test_stored_segments_spare_the_exchange_of_traces(spark):
    lengths = {f"j{k}": 3 + k for k in range(9)}
    norm, jobs = traces(spark, lengths), job_rows(spark, lengths)
    sizes = spark.createDataFrame(list(lengths.items()), "job_id string, length long")
    chunks = windows.chunk_index(sizes, WIN.stride).filter("chunk_idx <> 1")
    segs = windows.store_segments(norm, WIN.stride, 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = windows.training_windows(chunks, norm, jobs, WIN, segs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan[plan.index("Window") :].splitlines()
    scan = next(k for k, line in enumerate(lines) if "segments_" in line)
    assert "Bucketed: true" in lines[scan] and not any("Exchange" in line for line in lines[:scan])
    assert rows == sorted(map(tuple, windows.training_windows(chunks, norm, jobs, WIN).collect()))


def test_batch_files_are_in_order(spark, tmp_path):
    lengths = {f"j{k}": 7 + k % 5 for k in range(30)}
    norm, jobs = traces(spark, lengths), job_rows(spark, lengths)
    chunks = windows.chunk_index(spark.createDataFrame(list(lengths.items()), "job_id string, length long"), WIN.stride)
    plan = epochs.placed_plan(chunks, epoch=2, world=3, batch=4)
    path = str(tmp_path / "epoch")
    epochs.write_epoch(plan, windows.training_windows(chunks, norm, jobs, WIN), path, file_steps=3)
    want = sorted((r["rank"], r["step"], r["pos"], r["job_id"], r["chunk_idx"]) for r in plan.collect())
    got = [(r["rank"], r["step"], r["pos"], r["job_id"], r["chunk_idx"]) for r in epochs.read_epoch(spark, path).collect()]
    assert sorted(got) == want and len({w[:3] for w in want}) == len(want)
    index = epochs.read_index(spark, path).collect()
    assert all(r["n_samples"] == 4 for r in index) and len(index) == len({w[:2] for w in want})
    assert all(f"rank={r['rank']}/part={r['step'] // 3}/" in r["file_path"] for r in index)
    # One file, read as it lies, has its steps one after another.
    file = index[0]["file_path"]
    lie = [(r["step"], r["pos"]) for r in spark.read.parquet(file).collect()]
    assert lie == sorted(lie) and len({s for s, _ in lie}) <= 3
    late = epochs.read_epoch(spark, path, rank=1, first_step=4)
    assert sorted((r["step"], r["pos"]) for r in late.collect()) == [(w[1], w[2]) for w in want if w[0] == 1 and w[1] >= 4]
