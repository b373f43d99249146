"""The stages from raw files to scored traces, each resumable from its stored tables.

Traces, normalized traces and scores grow: every run appends one ``run=<id>`` folder of rows
and then one of completion records. Readers only accept runs with completion records, so a
stage that died between the two is redone and its stray folder ignored. The other tables
are written anew by every call, as versions of which the last complete one counts; so every
stage can be repeated, also after jobs have been added.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.config import PipelineConfig
from tracelake.operators import (
    coverage,
    epochs,
    evaluate,
    features,
    layout,
    normalize,
    progress,
    scoring,
    split,
    statistics,
    windows,
)
from tracelake.operators.resample import resample_traces
from tracelake.schemas import TRACES, require_columns
from tracelake.sources import files, tables, telemetry
from tracelake.storage import materialize

FACTS = (
    "job_id string, nodes_total long, nodes_used long, t0 double, k_max long, reason string, "
    "resampled boolean"
)
OUTCOMES = "job_id string, status string, detail string"
# Which of a run's trace files holds rows of which job.
MANIFEST = "job_id string, file string, bytes long"
# Files that one round of the resampling reads; a run that dies repeats one round.
BATCH_FILES = 100_000
SYNTH = "job_id string, k long, real_z double, gen_z double"
SCORED = "job_id string, error string"
NORMALIZED = "job_id string, k long, z0 float, z1 float, z2 float, z3 float"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """All runs of a stored table, or an empty table before the first run."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if not tables.exists(spark, path):
        return spark.createDataFrame([], schema.add("run", "string"))
    return spark.read.schema(T.StructType(list(schema)).add("run", "string")).parquet(path)


def _completed(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of the runs that left completion records: a partition filter of few values."""
    runs = [r["run"] for r in records.select("run").distinct().collect()]
    return rows.filter(F.col("run").isin(runs)).drop("run")


def load_facts(spark: SparkSession, out: str) -> DataFrame:
    """The facts of each finished job, by its last run that has them."""
    facts = _stored(spark, f"{out}/facts", FACTS)
    last = facts.groupBy("job_id").agg(F.max_by(F.struct(*facts.columns), F.struct("resampled", "run")).alias("f"))
    return last.select("f.*").drop("run")


def load_traces(spark: SparkSession, out: str) -> DataFrame:
    """Traces of completed runs; of a job that was resampled again only those of its last run."""
    records = _stored(spark, f"{out}/facts", FACTS).filter("resampled").select("job_id", "run")
    runs = [r["run"] for r in records.select("run").distinct().collect()]
    rows = _stored(spark, f"{out}/traces", T.StructType(list(TRACES))).filter(F.col("run").isin(runs))
    last = records.groupBy("job_id").agg(F.max("run").alias("last"), F.count("*").alias("n")).filter("n > 1")
    stale = records.join(last, "job_id").filter("run <> last").select("job_id", "run")
    return rows.join(stale, ["job_id", "run"], "left_anti").drop("run")


def pending_nodes(spark: SparkSession, source: str, out: str, cfg: PipelineConfig) -> DataFrame:
    """``(job_id, node_id, path, bytes)`` of the files of jobs that are not finished.

    A job is finished when its traces are stored and can be read, or when its facts are and its
    duration lies outside the bounds; wider bounds make such a job pending again.
    """
    facts, bounds = load_facts(spark, out), cfg.resample
    inside = F.round(F.col("k_max") * F.lit(bounds.dt), 3).between(bounds.lower_sec, bounds.upper_sec)
    done = facts.filter(F.col("resampled") | ~inside).select("job_id")
    done = done.join(damaged_outputs(spark, out).select("job_id"), "job_id", "left_anti")
    return telemetry.list_nodes(spark, source).join(done, "job_id", "left_anti")


def damaged_outputs(spark: SparkSession, out: str) -> DataFrame:
    """``(job_id, path, there)`` of finished jobs with a trace file that is gone or unreadable.

    Tasks list the trace folder and read the footers. A file counts as damaged if it is missing, has
    another size than when it was written, or no readable footer.
    """
    manifest = _stored(spark, f"{out}/manifest", MANIFEST)
    if not files.direct(out) or not tables.exists(spark, f"{out}/manifest"):
        return manifest.select("job_id", F.col("file").alias("path"), F.lit(False).alias("there"))
    last = manifest.groupBy("job_id").agg(F.max("run").alias("run"))
    wanted = manifest.join(last, ["job_id", "run"])
    name = F.concat_ws("/", F.substring_index(F.substring_index("path", "/", -2), "/", 1), F.substring_index("path", "/", -1))
    found = files.parquet_footers(files.list_one_below(spark, f"{out}/traces").filter(F.col("path").endswith(".parquet")))
    found = found.select("path", name.alias("name"), F.col("bytes").alias("found"), "rows")
    wanted = wanted.withColumn("name", F.concat(F.lit("run="), "run", F.lit("/"), "file"))
    checked = wanted.join(found, "name", "left")
    bad = F.col("rows").isNull() | (F.col("bytes") != F.col("found"))
    return checked.filter(bad).select("job_id", F.coalesce("path", "name").alias("path"), F.col("path").isNotNull().alias("there"))


def repair_outputs(spark: SparkSession, out: str) -> int:
    """Remove damaged trace files, so that tables can be read; their jobs are pending. Returns their number."""
    broken = damaged_outputs(spark, out).filter("there").select("path").distinct()
    return files.delete_files(broken)


def build_traces(
    spark: SparkSession, source: str, out: str, cfg: PipelineConfig, batch_files: int = BATCH_FILES
) -> DataFrame:
    """Resample the jobs of the CSV folder that are not finished; returns their outcomes.

    Pending jobs are done in rounds of about ``batch_files`` files, none of which is listed on the
    driver; files of finished jobs are listed but not opened. Of every file only the first rows are
    read at first; files are read to their end where the job can still pass. Only jobs within the
    duration bounds are resampled, the facts of the others are kept. Failed jobs are tried again by
    the next run, as are jobs whose stored traces have become unreadable. The state of every file
    that was read whole is stored in ``files``.
    """
    todo = materialize(pending_nodes(spark, source, out, cfg), "pending")
    repair_outputs(spark, out)
    rounds = -(-todo.count() // batch_files)
    todo = todo.withColumn("round", F.pmod(F.xxhash64("job_id"), F.lit(max(rounds, 1))))
    call = f"{out}/outcomes/{_new_run()}"
    for k in range(rounds):
        nodes = todo.filter(F.col("round") == k).drop("round")
        if not nodes.isEmpty():
            tables.write_table(_build_round(spark, nodes, source, out, cfg), f"{call}/round={k}")
    return _stored(spark, call, OUTCOMES).select("job_id", "status", "detail")


def _new_run() -> str:
    """Names of runs grow with the time of their start."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"


def _build_round(
    spark: SparkSession, nodes: DataFrame, source: str, out: str, cfg: PipelineConfig
) -> DataFrame:
    through_spark, bounds = not files.direct(source), cfg.resample
    heads = coverage.parse_metrics(telemetry.probe(nodes, bounds.probe_rows, through_spark))
    # Only the nodes to do get facts, and samples are joined with those.
    probed = materialize(coverage.node_facts(heads, bounds, nodes), "node-probes")
    kept = coverage.kept_nodes(probed, coverage.job_gate(probed, bounds)).select(*coverage.NODE)
    read = telemetry.ingest(nodes.join(kept, list(coverage.NODE)), through_spark)
    per_node = materialize(coverage.readable_nodes(probed, read.status), "node-facts")
    samples = coverage.parse_metrics(read.samples)
    facts = materialize(coverage.trace_facts(samples, bounds, per_node), "trace-facts")
    index = coverage.trace_index(facts, bounds)
    bounds = replace(bounds, grid_parts=layout.tasks_of(spark, coverage.grid_rows(index)))
    index = index.select("job_id", F.lit(True).alias("resampled"))
    run = _new_run()
    traces = resample_traces(samples, bounds, only_jobs=index, facts=per_node)
    tables.write_traces(traces, f"{out}/traces/run={run}")
    written = spark.read.schema(TRACES).parquet(f"{out}/traces/run={run}")
    places = written.select("job_id", "_metadata.file_name", "_metadata.file_size").distinct()
    tables.write_table(places.toDF("job_id", "file", "bytes"), f"{out}/manifest/run={run}")
    tables.write_table(read.status, f"{out}/files/run={run}")
    finished = facts.filter(F.col("reason").isNull()).join(index, "job_id", "left")
    finished = finished.withColumn("resampled", F.coalesce("resampled", F.lit(False)))
    tables.write_table(finished, f"{out}/facts/run={run}")
    return coverage.job_outcomes(facts)


def load_files(spark: SparkSession, out: str) -> DataFrame:
    """State of every telemetry file that was read whole, by run."""
    return _stored(spark, f"{out}/files", "job_id string, node_id string, path string, status string, n_rows long")


def load_index(spark: SparkSession, out: str, cfg: PipelineConfig) -> DataFrame:
    return coverage.trace_index(load_facts(spark, out), cfg.resample, f"{out}/traces")


def build_features(
    spark: SparkSession, scheduler_csv: str, out: str, cfg: PipelineConfig
) -> DataFrame:
    """Join the scheduler records with the index and write the feature table with its
    histogram and correlation tables."""
    scheduler = features.select_scheduler(tables.scan_scheduler(spark, scheduler_csv))
    index = features.select_index(load_index(spark, out, cfg))
    joined = features.require_rows(materialize(features.join_jobs(scheduler, index), "joined"))
    tables.write_version(features.build_features(joined, cfg.features), f"{out}/features")
    table = tables.read_version(spark, f"{out}/features")
    tables.write_version(statistics.histograms(table), f"{out}/histograms")
    tables.write_version(statistics.correlations(table), f"{out}/correlations")
    return table


def build_sequences(spark: SparkSession, out: str, cfg: PipelineConfig) -> DataFrame:
    """Split, fit, normalize and index the windows; returns the phase report."""
    table = require_columns(tables.read_version(spark, f"{out}/features"))
    labelled = materialize(split.split_jobs(split.usable_jobs(table), cfg.split), "labelled")
    traces = load_traces(spark, out)

    train = labelled.filter(F.col("split") == "train")
    sample = split.sample_jobs(train, cfg.norm.stats_sample_frac, cfg.split.seed)
    tables.write_version(normalize.fit_norm(traces, sample, cfg.norm), f"{out}/norm_stats")
    _normalize_jobs(spark, traces, labelled, out, cfg)
    jobs = normalize.attach_lengths(labelled, load_normalized(spark, out, cfg))
    tables.write_version(jobs, f"{out}/jobs", ("split",))
    rebuild_chunks(spark, out, cfg.window.stride, "chunks")
    sizes = [
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
    ]
    return progress.phase_report(
        {
            "load": split.drop_counts(table),
            "split": labelled.agg(*sizes),
            "jobs": load_jobs(spark, out).agg(*sizes),
            "chunks": load_chunks(spark, out).agg(*sizes),
        }
    )


def load_stats(spark: SparkSession, out: str) -> normalize.ChannelStats:
    return normalize.ChannelStats.from_table(tables.read_version(spark, f"{out}/norm_stats"))


def _normalized_path(spark: SparkSession, out: str, cfg: PipelineConfig) -> str:
    """Normalized traces lie by the statistics and bounds they were made with."""
    made = repr((sorted(load_stats(spark, out).by_channel.items()), cfg.norm.clip_lo, cfg.norm.clip_hi))
    return f"{out}/normalized/{hashlib.md5(made.encode()).hexdigest()}"


def _normalize_jobs(
    spark: SparkSession, traces: DataFrame, jobs: DataFrame, out: str, cfg: PipelineConfig
) -> None:
    """Normalize the jobs that the current statistics have not been applied to."""
    path = _normalized_path(spark, out, cfg)
    done = _stored(spark, f"{path}/jobs", "job_id string").select("job_id")
    todo = materialize(jobs.select("job_id").join(done, "job_id", "left_anti"), "to-normalize")
    if todo.isEmpty():
        return
    run = _new_run()
    kept = traces.join(todo, "job_id", "left_semi")
    stats = load_stats(spark, out)
    tables.write_table(normalize.normalize(kept, stats, cfg.norm), f"{path}/rows/run={run}")
    tables.write_table(todo, f"{path}/jobs/run={run}")


def load_normalized(spark: SparkSession, out: str, cfg: PipelineConfig) -> DataFrame:
    """Normalized traces of all jobs that ever were in the job table under these statistics."""
    path = _normalized_path(spark, out, cfg)
    records = _stored(spark, f"{path}/jobs", "job_id string")
    return _completed(_stored(spark, f"{path}/rows", NORMALIZED), records)


def load_chunks(spark: SparkSession, out: str, name: str = "chunks") -> DataFrame:
    chunks = tables.read_version(spark, f"{out}/{name}")
    return chunks.withColumn("job_id", F.col("job_id").cast("string"))


def load_jobs(spark: SparkSession, out: str) -> DataFrame:
    jobs = tables.read_version(spark, f"{out}/jobs")
    return jobs.withColumn("job_id", F.col("job_id").cast("string"))


def rebuild_chunks(spark: SparkSession, out: str, stride: int, name: str) -> None:
    """Window index for a stride, from the stored job table alone."""
    tables.write_version(
        windows.chunk_index(load_jobs(spark, out), stride), f"{out}/{name}", ("split",)
    )


def write_epochs(
    spark: SparkSession, out: str, cfg: PipelineConfig, first: int, last: int, world: int, batch: int
) -> list[str]:
    """Write the train batches of epochs ``first .. last - 1``; returns their folders.

    Segments are stored once and serve all epochs. An epoch that is already there is not written again.
    """
    jobs = load_jobs(spark, out).filter(F.col("split") == "train")
    chunks = load_chunks(spark, out).filter(F.col("split") == "train")
    norm = load_normalized(spark, out, cfg).join(jobs.select("job_id"), "job_id", "left_semi")
    segs, paths = None, []
    for epoch in range(first, last):
        paths.append(f"{out}/epochs/{world}x{batch}/epoch={epoch}")
        if tables.exists(spark, f"{paths[-1]}/index/_SUCCESS"):
            continue
        if segs is None:
            bins = jobs.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
            segs = windows.store_segments(norm, cfg.window.stride, layout.tasks_of(spark, bins))
        plan = epochs.placed_plan(chunks, epoch, world, batch, cfg.split.seed)
        tables.remove(spark, paths[-1])
        epochs.write_epoch(plan, windows.training_windows(chunks, norm, jobs, cfg.window, segs), paths[-1])
    return paths


def evaluate_jobs(
    spark: SparkSession,
    out: str,
    predictor: scoring.Predictor,
    cfg: PipelineConfig,
    subsample: int | None = None,
    strata: tuple[str, ...] = (),
) -> DataFrame:
    """Score the test jobs that have no stored trace and return the metrics of all.

    Stored traces are kept as they are; only their metrics are worked out again. A job whose
    scoring failed has a row without scores and with the ``error``; it is tried again by the next
    call. The summary, the aligned traces and their captions are stored as versions
    ``eval_summary``, ``eval_traces`` and ``eval_captions``.
    """
    norm = load_normalized(spark, out, cfg)
    jobs = load_jobs(spark, out).filter(F.col("split") == "test")
    if subsample is not None:
        jobs = split.stratified_subsample(jobs, subsample, strata, cfg.split.seed)
    jobs = materialize(jobs, "eval-jobs")
    done = _stored(spark, f"{out}/scored", SCORED).filter(F.col("error").isNull())
    todo = jobs.join(done.select("job_id"), "job_id", "left_anti")

    if not todo.isEmpty():
        plan = scoring.score_plan(scoring.windows_per_job(todo, cfg.window), cfg.window.w_pred)
        scored = materialize(
            scoring.score_jobs(norm, plan, windows.conditioning(todo), predictor, cfg.window),
            "scored",
        )
        run = _new_run()
        tables.write_table(scoring.unpack_scores(scored), f"{out}/synth/run={run}")
        outcome = scored.groupBy("job_id").agg(F.max("error").alias("error"))
        tables.write_table(outcome, f"{out}/scored/run={run}")
    synth = load_synth(spark, out).join(jobs.select("job_id"), "job_id", "left_semi")
    watts = evaluate.in_watts(synth, load_stats(spark, out))
    scored_at = _stored(spark, f"{out}/scored", SCORED).join(jobs.select("job_id"), "job_id", "left_semi")
    errors = scored_at.groupBy("job_id").agg(
        F.when(F.count_if(F.col("error").isNull()) == 0, F.max("error")).alias("error")
    )
    bin_sec = cfg.window.bin_sec
    summary = evaluate.trace_metrics(watts, bin_sec, jobs).join(errors, "job_id", "left")
    tables.write_version(summary, f"{out}/eval_summary")
    tables.write_version(evaluate.trace_export(watts, bin_sec), f"{out}/eval_traces")
    tables.write_version(evaluate.trace_captions(watts, jobs, bin_sec), f"{out}/eval_captions")
    return load_summary(spark, out)


def load_summary(spark: SparkSession, out: str) -> DataFrame:
    return tables.read_version(spark, f"{out}/eval_summary")


def report_jobs(spark: SparkSession, out: str, cfg: PipelineConfig, k: int = 6) -> DataFrame:
    """The k best, worst and random jobs of the stored summary, by ``pick``."""
    summary = load_summary(spark, out).drop("error")
    picks = {
        "best": evaluate.best_jobs(summary, k),
        "worst": evaluate.worst_jobs(summary, k),
        "random": summary.join(
            evaluate.random_scored_jobs(
                summary, load_synth(spark, out), summary, k, cfg.split.seed
            ).select("job_id"),
            "job_id",
        ),
    }
    rows = [df.select(F.lit(pick).alias("pick"), *summary.columns) for pick, df in picks.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def load_synth(spark: SparkSession, out: str) -> DataFrame:
    records = _stored(spark, f"{out}/scored", SCORED)
    return _completed(_stored(spark, f"{out}/synth", SYNTH), records)


def by_duration(cfg: PipelineConfig) -> PipelineConfig:
    """The same settings with as many windows per job as its duration needs."""
    return replace(cfg, window=replace(cfg.window, max_windows=None))
