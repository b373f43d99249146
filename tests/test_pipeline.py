import random
from dataclasses import replace

from pyspark.sql import functions as F

from tracelake.config import PipelineConfig, ResampleConfig, SplitConfig, WindowConfig
from tracelake.operators import epochs, evaluate, scoring
from tracelake.plans import pipeline

HEADER = "timestamp,utilization_gpu_pct,utilization_memory_pct,memory_used_MiB,power_draw_W"
CFG = PipelineConfig(
    resample=ResampleConfig(dt=1.0, dt_min=0.01, dt_max=3.0, lower_sec=5, upper_sec=100, block_bins=8),
    split=SplitConfig(test_frac=0.3),
    window=WindowConfig(w_ctx=8, w_pred=4, stride=4, bin_sec=1.0, max_windows=None),
)


def write_job(root, job, rng, samples=30):
    for node in ("a", "b"):
        lines = [
            f"{100 + 0.8 * i},{rng.randint(0, 99)},{rng.randint(0, 99)},{rng.randint(1, 900)},{rng.randint(1, 300)}"
            for i in range(samples)
        ]
        path = root / "raw" / f"d{int(job) % 3}" / f"{job}-{node}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join([HEADER, *lines]) + "\n")


def test_end_to_end_and_resume(spark, tmp_path):
    rng = random.Random(1)
    for j in range(8):
        write_job(tmp_path, str(j), rng)
    write_job(tmp_path, "8", rng, samples=1)
    out = str(tmp_path / "out")
    first = {r["job_id"]: (r["status"], r["detail"]) for r in pipeline.build_traces(spark, str(tmp_path / "raw"), out, CFG).collect()}
    assert first["8"] == ("failed", "low_node_ratio:0/2") and first["0"] == ("ok", "")

    write_job(tmp_path, "9", rng)
    second = pipeline.build_traces(spark, str(tmp_path / "raw"), out, CFG)
    assert sorted(r["job_id"] for r in second.collect()) == ["8", "9"]
    traces = pipeline.load_traces(spark, out)
    sizes = traces.groupBy("job_id").agg(F.count("*").alias("n"), F.max("k").alias("top")).collect()
    assert len(sizes) == 9 and all(r["n"] == r["top"] + 1 for r in sizes)
    index = {r["job_id"]: r for r in pipeline.load_index(spark, out, CFG).collect()}
    assert all(index[r["job_id"]]["length"] == r["n"] for r in sizes)

    sched = tmp_path / "slurm.csv"
    rows = ["id_job,cpus_req,mem_req,priority,state,job_type,time_start"]
    rows += [f"{j},{j + 1},{100 * j + 50},{3000 * (j + 1)},3,OTHER,{1640995200 + 999 * j}" for j in range(10)]
    sched.write_text("\n".join(rows) + "\n")
    pipeline.build_features(spark, str(sched), out, CFG)
    report = {(r["phase"], r["metric"]): r["value"] for r in pipeline.build_sequences(spark, out, CFG).collect()}
    assert report[("load", "kept")] == 9 and report[("split", "test")] == 3
    assert report[("chunks", "train")] == 6 * 6
    pipeline.rebuild_chunks(spark, out, 8, "chunks8")
    assert pipeline.load_chunks(spark, out, "chunks8").filter("split = 'train'").count() == 6 * 3

    small = pipeline.evaluate_jobs(spark, out, scoring.carry_predictor, CFG, subsample=2)
    before = {r["job_id"]: r["mae"] for r in small.collect()}
    assert len(before) == 2

    def broken(ctx, aux, cond):
        raise RuntimeError("out of order")

    failed = pipeline.evaluate_jobs(spark, out, broken, CFG)
    rows = {r["job_id"]: r for r in failed.collect()}
    assert len(rows) == 3 and sum("out of order" in (r["error"] or "") for r in rows.values()) == 1
    assert all(rows[j]["mae"] == before[j] for j in before)
    everything = pipeline.evaluate_jobs(spark, out, scoring.linear_predictor(0.0, 0.0), CFG)
    after = {r["job_id"]: r["mae"] for r in everything.collect()}
    assert len(after) == 3 and all(after[j] == before[j] for j in before)
    assert everything.filter("error IS NOT NULL").count() == 0
    assert evaluate.headline(everything).first()["n_jobs"] == 3
    assert everything.first()["duration_min"] == everything.first()["length"] / 60
    assert pipeline.load_synth(spark, out).select("job_id").distinct().count() == 3
    assert pipeline.report_jobs(spark, out, CFG, 1).groupBy("pick").count().count() == 3

    # Every stage once more, with a job in between.
    write_job(tmp_path, "12", rng)
    sched.write_text(sched.read_text() + "12,3,70,4000,3,OTHER,1640999000\n")
    third = pipeline.build_traces(spark, str(tmp_path / "raw"), out, CFG)
    assert sorted(r["job_id"] for r in third.collect()) == ["12", "8"]
    assert pipeline.build_features(spark, str(sched), out, CFG).count() == 10
    report = {(r["phase"], r["metric"]): r["value"] for r in pipeline.build_sequences(spark, out, CFG).collect()}
    assert report[("load", "kept")] == 10 and report[("jobs", "train")] == 7
    made = pipeline._normalized_path(spark, out, CFG)
    pipeline.build_sequences(spark, out, CFG)
    assert pipeline._normalized_path(spark, out, CFG) == made
    assert len(list((tmp_path / "out" / "normalized" / made.split("/")[-1] / "rows").glob("run=*"))) == 1
    pipeline.rebuild_chunks(spark, out, 8, "chunks8")
    assert pipeline.load_chunks(spark, out, "chunks8").filter("split = 'train'").count() == 7 * 3

    # Batch files of two epochs, each written once.
    paths = pipeline.write_epochs(spark, out, CFG, 0, 2, world=2, batch=3)
    chunks = pipeline.load_chunks(spark, out).filter("split = 'train'")
    for epoch, path in enumerate(paths):
        plan = epochs.epoch_plan(chunks, epoch, 2, 3, CFG.split.seed)
        key = lambda r: (r["rank"], r["step"], r["job_id"], r["chunk_idx"])
        rows = epochs.read_epoch(spark, path).collect()
        assert sorted(map(key, rows)) == sorted(map(key, plan.collect())) and len(rows[0]["ctx"]) == 4
        assert all(r["n_samples"] == 3 for r in epochs.read_index(spark, path).collect())
    files = sorted(f.stat().st_mtime_ns for f in (tmp_path / "out" / "epochs").rglob("*.parquet"))
    assert pipeline.write_epochs(spark, out, CFG, 0, 2, world=2, batch=3) == paths
    assert files == sorted(f.stat().st_mtime_ns for f in (tmp_path / "out" / "epochs").rglob("*.parquet"))


def test_finished_input_is_not_opened_and_bounds_may_widen(spark, tmp_path):
    rng = random.Random(2)
    for j in range(4):
        write_job(tmp_path, str(j), rng)
    write_job(tmp_path, "7", rng, samples=200)  # longer than the bounds
    source, out = str(tmp_path / "raw"), str(tmp_path / "out")
    first = pipeline.build_traces(spark, source, out, CFG, batch_files=4)
    assert first.count() == 5 and first.filter("status = 'ok'").count() == 5
    assert {r["job_id"] for r in pipeline.load_traces(spark, out).select("job_id").distinct().collect()} == set("0123")

    for file in (tmp_path / "raw").glob("*/*.csv"):  # a run that opened them would find nothing
        file.write_text("")
    assert pipeline.build_traces(spark, source, out, CFG).count() == 0
    assert pipeline.load_traces(spark, out).select("job_id").distinct().count() == 4

    rng = random.Random(3)
    write_job(tmp_path, "7", rng, samples=200)
    wide = replace(CFG, resample=replace(CFG.resample, upper_sec=1000))
    assert [r["job_id"] for r in pipeline.build_traces(spark, source, out, wide).collect()] == ["7"]
    assert pipeline.load_traces(spark, out).select("job_id").distinct().count() == 5
    assert pipeline.load_index(spark, out, wide).count() == 5
    assert pipeline.load_index(spark, out, CFG).count() == 4


def test_damaged_output_is_made_again(spark, tmp_path):
    """Only jobs with rows in the damaged file are redone, and no row is doubled."""
    rng = random.Random(4)
    source, out = str(tmp_path / "raw"), str(tmp_path / "out")
    for group in (range(3), range(3, 6)):
        for j in group:
            write_job(tmp_path, str(j), rng)
        pipeline.build_traces(spark, source, out, CFG)
    before = sorted(map(tuple, pipeline.load_traces(spark, out).collect()))
    assert pipeline.build_traces(spark, source, out, CFG).count() == 0

    first = sorted((tmp_path / "out" / "traces").glob("run=*"))[0]
    broken = max(first.glob("*.parquet"), key=lambda f: f.stat().st_size)
    hurt = {r["job_id"] for r in spark.read.parquet(str(broken)).select("job_id").distinct().collect()}
    broken.write_bytes(broken.read_bytes()[:-8])
    assert {r["job_id"] for r in pipeline.damaged_outputs(spark, out).collect()} == hurt
    redone = pipeline.build_traces(spark, source, out, CFG)
    assert {(r["job_id"], r["status"]) for r in redone.collect()} == {(j, "ok") for j in hurt}
    assert sorted(map(tuple, pipeline.load_traces(spark, out).collect())) == before
    assert pipeline.build_traces(spark, source, out, CFG).count() == 0
    assert pipeline.damaged_outputs(spark, out).count() == 0


def test_unreadable_file_is_an_unusable_node(spark, tmp_path):
    """A node whose file lacks a column below its head counts against its job's share of nodes."""
    rng = random.Random(5)
    for j in range(3):
        write_job(tmp_path, str(j), rng)
    (tmp_path / "raw" / "d1" / "1-b.csv").write_text("")
    (tmp_path / "raw" / "d2" / "2-b.csv").write_text(HEADER.replace("power", "other") + "\n1,2,3,4,5\n")
    out = str(tmp_path / "out")
    got = {r["job_id"]: r["detail"] for r in pipeline.build_traces(spark, str(tmp_path / "raw"), out, CFG).collect()}
    assert got == {"0": "", "1": "low_node_ratio:1/2", "2": "low_node_ratio:1/2"}
    # Jobs that the heads reject are not read.
    assert {r["job_id"] for r in pipeline.load_files(spark, out).collect()} == {"0"}
