import math
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracelake.config import SOURCE_METRICS, ResampleConfig
from tracelake.operators import coverage, resample

CFG = ResampleConfig(dt=1.0, dt_min=0.001, dt_max=3.0, lower_sec=0, upper_sec=1e9, block_bins=4)
SCHEMA = "job_id string, node_id string, seq long, timestamp double, " + ", ".join(
    f"{c} double" for c in SOURCE_METRICS
)


def frame(spark, nodes, job="1"):
    rows = []
    for node, samples in nodes.items():
        for i, s in enumerate(samples):
            ts, *vals = s
            rows.append((job, node, i, ts, *[None if v is None else float(v) for v in vals]))
    return spark.createDataFrame(rows, SCHEMA)


def watts(spark, df, cfg=CFG):
    out = resample.resample_traces(df, cfg).orderBy("job_id", "k").collect()
    return [(r["k"], r["power_draw_W"]) for r in out]


def test_sampling_interval(spark):
    def interval(ts, probe=50):
        df = frame(spark, {"a": [(t, 0, 0, 0, 0) for t in ts]})
        return coverage.probe_nodes(df, replace(CFG, probe_rows=probe)).first()["interval"]

    assert interval([0.0, 0.0, 0.1, 0.2]) == pytest.approx(0.1)
    assert interval([5.0, 5.0]) is None
    # The probe counts raw rows, a bad first value included.
    assert interval([None, 5.0, 7.0], probe=2) is None
    assert interval([None, 5.0, 7.0], probe=3) == pytest.approx(2.0)


NODE_A = [(10.0, 50, 10, 100, 40), (10.0, 70, 30, 200, 60), (10.5, 80, 40, 300, 100), (12.2, 20, 0, 50, 30)]
NODE_B = [(11.0, 30, 50, 10, 5), (13.0, 50, 70, 30, 15)]


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_chain(spark, block):
    df = frame(spark, {"a": NODE_A, "b": NODE_B})
    out = resample.resample_traces(df, replace(CFG, block_bins=block)).orderBy("k").collect()
    assert [tuple(r)[1:] for r in out] == [
        (0, 0.0, 70.0, 30.0, 300.0, 100.0),
        (1, 1.0, 50.0, 40.0, 310.0, 105.0),
        (2, 2.0, 25.0, 25.0, 60.0, 35.0),
        (3, 3.0, 50.0, 70.0, 30.0, 15.0),
    ]
    index = coverage.trace_index(coverage.trace_facts(df, CFG), CFG).first()
    assert (index["nodes_used"], index["length"], index["duration_sec"]) == (2, 4, 3.0)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_negative_bins_are_dropped_not_carried(spark, block):
    cfg = replace(CFG, block_bins=block)
    df = frame(spark, {"a": [(10.0, 0, 0, 0, 1), (8.0, 0, 0, 0, 9), (11.0, 0, 0, 0, 2)]})
    assert watts(spark, df, cfg) == [(0, 1.0), (1, 2.0)]


def test_node_carries_over_from_negative_bins(spark):
    # The origin is the earliest first row; the node's own second row lies before it.
    a = [(10.0, 0, 0, 0, 3), (7.0, 0, 0, 0, 9), (12.0, 0, 0, 0, 4)]
    for block in (1, 2, 64):
        df = frame(spark, {"a": a})
        assert watts(spark, df, replace(CFG, block_bins=block)) == [(0, 3.0), (1, 3.0), (2, 4.0)]


def test_only_negative_bins(spark):
    # The rejected node sets the origin (its first row), the kept one lies before it.
    nodes = {
        "a": [(20.0, 0, 0, 0, 1), (8.0, 0, 0, 0, 1), (9.0, 0, 0, 0, 1)],
        "b": [(19.0, 0, 0, 0, 1)],
    }
    cfg = replace(CFG, probe_rows=3, dt_max=100.0, min_node_keep_ratio=0.1)
    facts = coverage.trace_facts(frame(spark, nodes), cfg).first()
    assert facts["t0"] == 19.0 and facts["k_max"] == 1 and facts["reason"] is None
    late = {"a": [(None, 0, 0, 0, 1), (8.0, 0, 0, 0, 1), (9.0, 0, 0, 0, 1)], "b": [(19.0, 0, 0, 0, 1)]}
    out = coverage.job_outcomes(coverage.trace_facts(frame(spark, late), cfg)).first()
    assert (out["status"], out["detail"]) == ("failed", "neg_kmax")
    assert coverage.exit_status(coverage.job_outcomes(coverage.trace_facts(frame(spark, late), cfg))) == 1
    assert watts(spark, frame(spark, late), cfg) == []


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_missing_values(spark, block):
    cfg = replace(CFG, block_bins=block)
    df = frame(
        spark,
        {"a": [(0.0, None, 1, 1, None), (1.0, None, None, 1, 2), (2.0, 40, None, 1, 3), (3.0, None, 5, 1, 4)]},
    )
    out = resample.resample_traces(df, cfg).orderBy("k").collect()
    assert [r["power_draw_W"] for r in out] == [0.0, 2.0, 3.0, 4.0]
    assert [r["gpu_used_pct"] for r in out] == [40.0, 40.0, 40.0, 40.0]
    assert [r["memory_used_pct"] for r in out] == [1.0, 1.0, 1.0, 5.0]
    empty = frame(spark, {"a": [(0.0, None, 1, 1, 1), (1.0, None, 1, 1, 1)]})
    assert [r["gpu_used_pct"] for r in resample.resample_traces(empty, cfg).collect()] == [0.0, 0.0]


def _ratio(spark, usable, total):
    nodes = {f"n{i}": [(0.0, 0, 0, 0, 1), (1.0, 0, 0, 0, 1)] for i in range(usable)}
    nodes |= {f"x{i}": [(0.0, 0, 0, 0, 1)] for i in range(total - usable)}
    facts = coverage.node_facts(frame(spark, nodes), CFG)
    return coverage.job_gate(facts, CFG).first()["reason"]


def test_node_ratio(spark):
    assert _ratio(spark, 2, 4) == "low_node_ratio:2/4"
    assert _ratio(spark, 3, 4) is None
    assert _ratio(spark, 0, 2) == "low_node_ratio:0/2"


def test_registered_empty_node_counts(spark):
    df = frame(spark, {"a": [(0.0, 0, 0, 0, 1), (1.0, 0, 0, 0, 1)]})
    nodes = spark.createDataFrame([("1", "a"), ("1", "b")], "job_id string, node_id string")
    facts = coverage.node_facts(df, CFG, nodes)
    assert coverage.job_gate(facts, CFG).first()["reason"] == "low_node_ratio:1/2"
    assert resample.resample_traces(df, CFG, nodes=nodes).count() == 0


def test_duration_bounds(spark):
    cfg = ResampleConfig(dt=0.1, lower_sec=300, upper_sec=7200)
    facts = spark.createDataFrame(
        [(str(i), 1, k, None) for i, k in enumerate((2999, 3000, 72000, 72001))],
        "job_id string, nodes_used long, k_max long, reason string",
    )
    assert sorted(r["job_id"] for r in coverage.trace_index(facts, cfg).collect()) == ["1", "2"]
    none = coverage.trace_index(facts.limit(0), cfg)
    assert none.count() == 0 and none.columns[0] == "job_id"


def _brute(nodes, dt):
    """Dense grid of one job by plain loops."""
    t0 = min(rows[0][0] for rows in nodes.values())
    grids = []
    for rows in nodes.values():
        per_ts, bins = {}, {}
        for ts, *v in rows:
            per_ts.setdefault(ts, []).append(v)
        for ts, vs in per_ts.items():
            k = math.floor((ts - t0) / dt + 1e-12)
            merged = []
            for m in range(4):
                known = [v[m] for v in vs if v[m] is not None]
                merged.append(
                    sum(known) if m >= 2 else (sum(known) / len(known) if known else None)
                )
            bins.setdefault(k, []).append(merged)
        grid, last = {}, [None] * 4
        for k in range(min(bins), max(bins) + 1):
            for m in range(4):
                known = [b[m] for b in bins.get(k, []) if b[m] is not None]
                if known:
                    last[m] = sum(known) / len(known)
            grid[k] = list(last)
        grids.append(grid)
    hi = max(max(g) for g in grids)
    out = []
    for k in range(hi + 1):
        here = [g[k] for g in grids if k in g]
        row = []
        for m in range(4):
            known = [v[m] for v in here if v[m] is not None]
            if m >= 2:
                row.append(float(sum(known)) if here else None)
            else:
                row.append(sum(known) / len(known) if known else None)
        out.append(row)
    for m in range(4):
        for order in (range(hi + 1), range(hi, -1, -1)):
            last = None
            for k in order:
                if out[k][m] is None:
                    out[k][m] = last
                else:
                    last = out[k][m]
        for k in range(hi + 1):
            if out[k][m] is None:
                out[k][m] = 0.0
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 4096])
def test_against_brute_force(spark, block):
    import random

    rng = random.Random(5)
    jobs = {}
    for j in range(12):
        nodes = {}
        for n in range(3):
            t, rows = rng.uniform(0, 30), []
            for _ in range(rng.randint(3, 25)):
                v = [rng.choice([None, float(rng.randint(0, 99))]) for _ in range(4)]
                rows += [(t, *v)] * rng.choice([1, 1, 2])
                t += rng.choice([0.3, 0.9, 1.0, 2.5, 17.0])
            if rng.random() < 0.5:  # a late first row: earlier samples fall before the origin
                rows.insert(0, rows.pop(rng.randrange(1, len(rows))))
            nodes[f"n{n}"] = rows
        jobs[str(j)] = nodes
    df = None
    for job, nodes in jobs.items():
        part = frame(spark, nodes, job)
        df = part if df is None else df.unionByName(part)
    cfg = replace(CFG, dt_max=1e6, block_bins=block)
    got = {}
    for r in resample.resample_traces(df, cfg).orderBy("job_id", "k").collect():
        got.setdefault(r["job_id"], []).append(r)
    assert any(rows[0][0] > rows[1][0] for nodes in jobs.values() for rows in nodes.values())
    for job, nodes in jobs.items():
        want = _brute(nodes, 1.0)
        assert [r["k"] for r in got[job]] == list(range(len(want)))
        for r, w in zip(got[job], want):
            assert list(r)[3:] == pytest.approx(w, rel=1e-6), (job, r)


def test_partition_count_does_not_matter(spark):
    df = frame(spark, {"a": NODE_A, "b": NODE_B}).unionByName(frame(spark, {"c": NODE_A}, "2"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, resample.resample_traces(df, CFG).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_parse(spark):
    raw = spark.createDataFrame(
        [("1", "a", 0, " 1.5 ", "x", "1.5d", "", "nan"), ("1", "a", 1, "inf", "-2", "3e2", None, "7")],
        "job_id string, node_id string, seq long, timestamp string, " + ", ".join(f"{c} string" for c in SOURCE_METRICS),
    )
    rows = coverage.parse_metrics(raw).orderBy("seq").collect()
    assert list(rows[0])[3:] == [1.5, None, None, None, None]
    assert list(rows[1])[3:] == [None, -2.0, 300.0, None, 7.0]


def test_rollup_runs_in_the_layout_of_the_join(spark):
    """Without a broadcast the samples are shuffled by the join alone."""
    df = frame(spark, {"a": NODE_A, "b": NODE_B})
    layout = r"Exchange hashpartitioning\(job_id#\d+, node_id#\d+, part#\d+"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rollup = resample.gpu_rollup(resample.locate(df, coverage.kept_nodes(*_gates(df)), CFG))
    plan = rollup._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One exchange of the samples, one of the nodes, none for the rollup.
    assert len(re.findall(layout + r", \d", plan)) == 2, plan
    assert not re.findall(layout + r", timestamp", plan), plan


def _gates(df):
    facts = coverage.node_facts(df, CFG)
    return facts, coverage.job_gate(facts, CFG)


def test_a_hot_node_spans_several_tasks(spark):
    samples = [(10.0 + 0.5 * i, 50, 50, 10, i % 9) for i in range(2000)]
    df = frame(spark, {"a": samples, "b": samples[:5]})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rollup = resample.gpu_rollup(resample.locate(df, coverage.kept_nodes(*_gates(df)), CFG))
    binned = resample.bin_samples(rollup, CFG)
    for rows in (rollup, binned):
        counts = rows.filter("node_id = 'a'").groupBy(F.spark_partition_id()).count().collect()
        assert len(counts) > 1 and max(r["count"] for r in counts) < 0.8 * sum(r["count"] for r in counts)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plan_has_no_single_task_and_no_all_pairs(spark):
    df = frame(spark, {"a": NODE_A, "b": NODE_B})
    plan = resample.resample_traces(df, CFG)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(job_id" in plan
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan


def test_only_hot_nodes_are_joined_in_parts(spark):
    """With the samples of nodes known, a hot node has parts and gives the same rows."""
    samples = [(10.0 + 0.5 * (i // 2), 50, 50, 10, i % 9) for i in range(2000)]
    df = frame(spark, {"a": samples, "b": samples[:5]})
    kept = coverage.kept_nodes(*_gates(df))
    sized = kept.withColumn("n_rows", F.when(F.col("node_id") == "a", 2000).otherwise(5).cast("long"))
    want = sorted(map(tuple, resample.gpu_rollup(resample.locate(df, kept, CFG)).collect()))
    plain = resample.locate(df, sized, CFG)
    assert "part" not in plain.columns and sorted(map(tuple, resample.gpu_rollup(plain).collect())) == want
    hot = resample.locate(df, sized, replace(CFG, hot_rows=500))
    parts = {(r["node_id"], r["part"]) for r in hot.select("node_id", "part").distinct().collect()}
    assert parts == {("b", 0), *(("a", k) for k in range(4))}
    assert sorted(map(tuple, resample.gpu_rollup(hot).collect())) == want
