"""Registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import schemas, storage
from tracelake.config import FEATURES, SOURCE_METRICS
from tracelake.operators import (
    coverage,
    epochs,
    evaluate,
    features,
    normalize,
    progress,
    quantiles,
    resample,
    scoring,
    split,
    statistics,
    windows,
)
from tracelake.plans import bindings
from tracelake.plans.flow import EventRun, LargeRun, run
from tracelake.sources import tables, telemetry

CFG = bindings.CONFIG
RS = CFG.resample
FC = bindings.LARGE.features
STRATA = ("type_batch", "type_interactive", "type_map", "type_other", "nodes_req_is_one")
METRIC_SHORT = dict(zip(SOURCE_METRICS, ("util", "mem_pct", "mem_mib", "watts")))


def _events(spark, sf) -> EventRun:
    return run(EventRun, spark, sf)


def _large(spark, sf) -> LargeRun:
    return run(LargeRun, spark, sf)


def _rounded(df: DataFrame, keys, places: int = 4, **names) -> DataFrame:
    """Keys as they are, everything in ``names`` (output=source) rounded."""
    return df.select(
        *keys, *[F.round(F.col(src).cast("double"), places).alias(out) for out, src in names.items()]
    )


def _metrics(df: DataFrame, *keys) -> DataFrame:
    return _rounded(df, keys, **{short: src for src, short in METRIC_SHORT.items()})


def _digits(values: Column) -> Column:
    """An array of floats as text: hundred-thousandths, comma separated."""
    as_text = F.transform(
        values, lambda x: F.round(x.cast("double") * 1e5).cast("long").cast("string")
    )
    return F.array_join(as_text, ",")


# ── Sources, sinks, progress ────────────────────────────────────────────────
def csv_ingest(spark, sf):
    # Some units have their columns in another order beside one more. Beside all units lie damaged copies of
    # some, without a column, and a file without a line.
    path, rows = storage.scratch_path(spark, "csv"), bindings.telemetry(spark, sf)
    names, number = schemas.TELEMETRY_CSV.fieldNames(), F.col("job_id").cast("long")
    turned = number % 5 == 0
    telemetry.write_telemetry(rows.filter(~turned), path)
    telemetry.write_telemetry(rows.withColumn("more", F.lit("x,y")).filter(turned), path, ["more", *names[::-1]])
    copies = rows.filter(number % 50 == 3).withColumn("job_id", F.concat(F.lit("9000"), "job_id"))
    telemetry.write_telemetry(copies, path, names[:-1])
    empty = spark.createDataFrame([("90009-empty", None)], "unit string, value string").coalesce(1)
    empty.write.mode("append").partitionBy("unit").option("emptyValue", "").csv(path)
    parsed = coverage.parse_metrics(telemetry.scan_telemetry(spark, path, layout="folder"))
    pos = F.row_number().over(Window.partitionBy(*coverage.NODE).orderBy("seq"))
    return _rounded(
        parsed.withColumn("pos", pos), ("job_id", "node_id", "pos"), 6,
        ts="timestamp", util=SOURCE_METRICS[0], mem_pct=SOURCE_METRICS[1],
        mem_mib=SOURCE_METRICS[2], watts=SOURCE_METRICS[3],
    )


def tolerant_parse(spark, sf):
    parsed = coverage.parse_metrics(bindings.dirty_telemetry(spark, sf))
    kept = parsed.filter(F.col("timestamp").isNotNull())
    return kept.groupBy(*coverage.NODE).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(c).alias(f"n_{s}") for c, s in METRIC_SHORT.items()],
        *[F.round(F.sum(c), 3).alias(f"sum_{s}") for c, s in METRIC_SHORT.items()],
    )


def scheduler_csv(spark, sf):
    path = storage.scratch_path(spark, "scheduler")
    raw = bindings.scheduler_raw(spark, sf).withColumn("unused", F.lit("x"))
    raw.select("unused", *reversed(raw.columns[:-1])).write.option("header", True).csv(path)
    return features.select_scheduler(tables.scan_scheduler(spark, path))


def trace_index_dedup(spark, sf):
    raw = bindings.large_index_raw(spark, sf)
    return features.select_index(raw.unionByName(raw))


def trace_sink_roundtrip(spark, sf):
    path = storage.scratch_path(spark, "traces")
    tables.write_traces(resample.resample_traces(bindings.telemetry(spark, sf), RS), path)
    return _traces(tables.read_traces(spark, path))


def trace_index(spark, sf):
    facts = coverage.trace_facts(bindings.telemetry(spark, sf), RS)
    return coverage.trace_index(facts, RS).select(
        "job_id", "nodes_used", "file_path", "length", "duration_sec", "delta_t"
    )


def packed_traces(spark, sf):
    r = _events(spark, sf)
    packed = normalize.pack(r.norm, r.index, int(RS.upper_sec / RS.dt) + 1)
    return packed.select(
        "job_id", "length", *[_digits(F.col("ch")[i]).alias(f"ch{i}") for i in range(4)]
    )


def split_sink_roundtrip(spark, sf):
    path = storage.scratch_path(spark, "chunks")
    tables.write_table(_events(spark, sf).chunks, path, ("split",))
    stored = spark.read.schema("job_id string, chunk_idx long, split string").parquet(path)
    return stored.select("split", "job_id", "chunk_idx")


def pending_units(spark, sf):
    listing = bindings.listing(spark, sf)
    manifest = listing.filter("present").select("key", "bytes")
    return progress.pending_units(listing.select("key"), manifest, 1000)


def fetch_plan(spark, sf):
    listing = bindings.listing(spark, sf)
    return progress.fetch_plan(listing, listing.filter("present"), 20)


def job_outcomes(spark, sf):
    return coverage.job_outcomes(coverage.trace_facts(bindings.telemetry(spark, sf), RS))


def phase_report(spark, sf):
    r = _events(spark, sf)
    ok = F.col("status") == "ok"
    outcomes = coverage.job_outcomes(r.facts).agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed")
    )
    sizes = r.jobs.agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
    )
    chunks = r.chunks.agg(
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "test").alias("test"),
    )
    return progress.phase_report(
        {
            "resample": outcomes,
            "load": split.drop_counts(r.features),
            "split": sizes,
            "chunks": chunks,
        }
    )


# ── Resampling ──────────────────────────────────────────────────────────────
def sampling_interval(spark, sf):
    probe = coverage.probe_nodes(bindings.telemetry(spark, sf), RS)
    return _rounded(probe, coverage.NODE, 6, first_ts="first_ts", interval="interval")


def _facts(spark, sf):
    return coverage.node_facts(bindings.telemetry(spark, sf), RS)


def rate_gate(spark, sf):
    return _facts(spark, sf).select(*coverage.NODE, F.col("usable").cast("int").alias("usable"))


def _located(spark, sf):
    facts = _facts(spark, sf)
    kept = coverage.kept_nodes(facts, coverage.job_gate(facts, RS))
    return resample.locate(bindings.telemetry(spark, sf), kept, RS)


def gpu_rollup(spark, sf):
    rolled = resample.gpu_rollup(_located(spark, sf))
    return _rounded(
        rolled, (*coverage.NODE, "k"), 6, ts="timestamp",
        **{short: src for src, short in METRIC_SHORT.items()},
    )


def job_t0(spark, sf):
    gate = coverage.job_gate(_facts(spark, sf), RS)
    return _rounded(gate, ("job_id",), 6, t0="t0")


def node_ratio_gate(spark, sf):
    gate = coverage.job_gate(_facts(spark, sf), RS)
    return gate.select("job_id", "nodes_used", "nodes_total", F.coalesce("reason", F.lit("")).alias("reason"))


def _binned(spark, sf):
    return resample.bin_samples(resample.gpu_rollup(_located(spark, sf)), RS)


def time_bins(spark, sf):
    return _metrics(_binned(spark, sf), *coverage.NODE, "k")


def node_grid_ffill(spark, sf):
    return _metrics(resample.densify_nodes(_binned(spark, sf), RS), *coverage.NODE, "k")


def _cross(spark, sf):
    return resample.combine_nodes(resample.densify_nodes(_binned(spark, sf), RS))


def cross_node_agg(spark, sf):
    return _metrics(_cross(spark, sf), "job_id", "k")


def job_grid_fill(spark, sf):
    binned = _binned(spark, sf)
    cross = resample.combine_nodes(resample.densify_nodes(binned, RS))
    return _metrics(resample.densify_jobs(cross, binned, RS), "job_id", "k")


def _traces(traces):
    return _rounded(
        traces, ("job_id", "k"), 3, timestamp="timestamp", gpu_used_pct="gpu_used_pct",
        memory_used_pct="memory_used_pct", memory_used_MiB="memory_used_MiB",
        power_draw_W="power_draw_W",
    )


def trace_projection(spark, sf):
    """Storage types and relative time of the bins before the last fill."""
    return _traces(resample.finalize(_cross(spark, sf), RS))


def resampled_traces(spark, sf):
    return _traces(resample.resample_traces(bindings.telemetry(spark, sf), RS))


# ── Features ────────────────────────────────────────────────────────────────
def _joined(spark, sf):
    return _large(spark, sf).joined


def jobs_joined(spark, sf):
    return _joined(spark, sf).select(
        "job_id", "cpus_req", "mem_req", F.round("priority", 6).alias("priority"), "state",
        "job_type", "time_start", "file_path", "nodes_req", "duration_sec", "length",
    )


def cyclical_time(spark, sf):
    cols = features.cyclical_columns(F.col("time_start"), FC)
    return _rounded(_joined(spark, sf).withColumns(cols), ("job_id",), 9, **{c: c for c in cols})


def mem_sentinel(spark, sf):
    out = _joined(spark, sf).withColumns(features.memory_columns(FC))
    return out.select("job_id", "mem_unlimited", "mem_known")


def quantile_fit(spark, sf):
    inputs = features.scaling_inputs(_joined(spark, sf), FC)
    table = quantiles.quantile_table(inputs, features.scaling_targets(FC))
    return _rounded(table, ("column_name", "i", "n"), 6, q="q")


def _scaled(spark, sf, source, output):
    inputs = features.scaling_inputs(_joined(spark, sf), FC)
    target = {source: features.scaling_targets(FC)[source]}
    model = quantiles.QuantileNormal.fit(inputs, target)
    return model.transform(inputs, source, output)


def quantile_normal(spark, sf):
    """The transform on a heavily tied column of small integers."""
    jobs = _joined(spark, sf).select("job_id", F.col("nodes_req").cast("double").alias("x"))
    model = quantiles.QuantileNormal.fit(jobs, {"x": 100})
    return _rounded(model.transform(jobs, "x", "z"), ("job_id",), 6, z="z")


def mem_req_scaled(spark, sf):
    out = _scaled(spark, sf, "mem_known", "z").withColumn("z", F.coalesce("z", F.lit(0.0)))
    return _rounded(out, ("job_id",), 6, mem_req_scaled="z")


def cpus_req_scaled(spark, sf):
    return _rounded(_scaled(spark, sf, "cpus_log", "z"), ("job_id",), 6, cpus_req_scaled="z")


def duration_scaled(spark, sf):
    return _rounded(_scaled(spark, sf, "duration_log", "z"), ("job_id",), 6, duration_scaled="z")


def priority_scaled(spark, sf):
    return _rounded(_scaled(spark, sf, "priority_log", "z"), ("job_id",), 6, priority_scaled="z")


def node_features(spark, sf):
    out = _joined(spark, sf).withColumns(features.node_columns(FC))
    return out.select("job_id", "nodes_req_is_one", F.round("nodes_req_log", 9).alias("nodes_req_log"))


def priority_tier(spark, sf):
    tier = features.priority_tier(F.col("priority"), FC.tier_thresholds)
    return _joined(spark, sf).select("job_id", tier.cast("int").alias("tier"))


def _categories(spark, sf, prefix):
    cols = {c: e for c, e in features.category_columns(FC).items() if c.startswith(prefix)}
    return _joined(spark, sf).select("job_id", *[e.alias(c) for c, e in cols.items()])


def one_hot_tier(spark, sf):
    return _categories(spark, sf, "ptier_")


def job_type_onehot(spark, sf):
    return _categories(spark, sf, "type_")


def state_onehot(spark, sf):
    return _categories(spark, sf, "state_")


def _feature_view(df):
    measured = [*FEATURES, "dom_sin", "dom_cos"]
    return _rounded(
        df, ("job_id", "file_path", "nodes_req", "duration_sec", "length"), 6, **{c: c for c in measured}
    )


def job_features(spark, sf):
    return _feature_view(features.build_features(_joined(spark, sf), FC))


def feature_histograms(spark, sf):
    # Features meet bin edges exactly, so noise in the last digit is rounded off first.
    jobs = _large(spark, sf).features
    steady = [
        F.round(c, 9).alias(c) if kind == "double" and c != "duration_sec" else F.col(c)
        for c, kind in jobs.dtypes
    ]
    h = statistics.histograms(jobs.select(*steady))
    return h.select("column_name", "bin", F.round("left_edge", 6).alias("left_edge"), "n")


def feature_correlation(spark, sf):
    jobs = _large(spark, sf).features
    ordered = ("nodes_req", "duration_sec", "length", *FEATURES, "dom_sin", "dom_cos")
    c = statistics.correlations(jobs.select("job_id", *ordered))
    return c.select("col_a", "col_b", F.round("r", 6).alias("r"))


# ── Split, normalization, window index ──────────────────────────────────────
def required_columns(spark, sf):
    return schemas.column_report(_large(spark, sf).features)


def finite_jobs(spark, sf):
    return split.usable_jobs(_large(spark, sf).features).select("job_id", "length")


def split_random(spark, sf):
    s = CFG.split
    return split.random_split(_large(spark, sf).jobs, s.test_frac, s.seed).select("job_id", "split")


def _stratified(spark, sf):
    s = CFG.split
    return split.stratified_split(_large(spark, sf).jobs, STRATA, s.test_frac, s.seed)


def split_stratified(spark, sf):
    return _stratified(spark, sf).select("job_id", "stratum", "split")


def split_coverage(spark, sf):
    return split.split_coverage(_stratified(spark, sf))


def stats_sample(spark, sf):
    return split.sample_jobs(_large(spark, sf).jobs, 0.25, CFG.split.seed).select("job_id")


def norm_stats(spark, sf):
    r = _events(spark, sf)
    table = normalize.fit_norm(r.traces, r.part("train"), CFG.norm)
    return _rounded(table, ("channel", "norm"), 6, log_mean="log_mean", log_std="log_std")


def normalized_traces(spark, sf):
    return _rounded(
        _events(spark, sf).norm, ("job_id", "k"), 5, z0="z0", z1="z1", z2="z2", z3="z3"
    )


def chunk_index(spark, sf):
    s = CFG.split
    jobs = split.random_split(_large(spark, sf).jobs, s.test_frac, s.seed)
    return windows.chunk_index(jobs, bindings.LARGE.window.stride)


def chunk_reindex(spark, sf):
    """A new stride over the stored job table; nothing is refitted or renormalized."""
    return windows.chunk_index(_events(spark, sf).jobs, 48)


# ── Windows and epochs ──────────────────────────────────────────────────────
def _windows(spark, sf):
    r = _events(spark, sf)
    return windows.cut_windows(windows.segments(r.norm, CFG.window.stride), CFG.window)


def _channels(df, column, n):
    return [_digits(F.col(column)[i]).alias(f"{column}{i}") for i in range(n)]


def window_context(spark, sf):
    w = _windows(spark, sf)
    return w.select("job_id", "chunk_idx", *_channels(w, "ctx", 4))


def window_future(spark, sf):
    w = _windows(spark, sf)
    return w.select(
        "job_id", "chunk_idx", *_channels(w, "future_aux", 3), _digits(F.col("target")).alias("target")
    )


def window_mask(spark, sf):
    return _windows(spark, sf).select(
        "job_id", "chunk_idx", F.array_join(F.transform("pred_mask", lambda x: x.cast("int").cast("string")), "").alias("mask"),
    )


def window_cond(spark, sf):
    cond = windows.conditioning(_events(spark, sf).jobs)
    return cond.select("job_id", F.posexplode("cond").alias("pos", "v")).select(
        "job_id", "pos", F.round(F.col("v").cast("double"), 5).alias("v")
    )


def training_windows(spark, sf):
    r = _events(spark, sf)
    out = windows.training_windows(
        r.chunks.filter(F.col("split") == "train"), r.norm, r.jobs, CFG.window
    )
    mask = F.aggregate("pred_mask", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("long")
    cond = F.aggregate("cond", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select(
        "job_id",
        "chunk_idx",
        *_channels(out, "ctx", 4),
        *_channels(out, "future_aux", 3),
        _digits(F.col("target")).alias("target"),
        mask.alias("n_real"),
        F.round(cond, 4).alias("cond_sum"),
    )


def _train_chunks(spark, sf):
    return _events(spark, sf).chunks.filter(F.col("split") == "train")


def epoch_plan(spark, sf):
    return epochs.epoch_plan(_train_chunks(spark, sf), epoch=3, world=2, batch=16)


def batch_layout(spark, sf):
    plan = epochs.epoch_plan(_train_chunks(spark, sf), epoch=0, world=3, batch=8, max_steps=12)
    return epochs.batch_layout(plan)


def _assembled(spark, sf, max_steps=None):
    r, chunks = _events(spark, sf), _train_chunks(spark, sf)
    plan = epochs.epoch_plan(chunks, epoch=0, world=3, batch=8, max_steps=max_steps)
    placed = epochs.assemble_batches(plan, windows.training_windows(chunks, r.norm, r.jobs, CFG.window))
    return placed.select(
        "rank", "step", F.col("pos").cast("long").alias("pos"), "job_id", "chunk_idx",
        F.md5(_digits(F.col("target"))).alias("target_md5"),
        F.md5(_digits(F.col("ctx")[3])).alias("ctx_3_md5"),
    )


def assembled_batches(spark, sf):
    return _assembled(spark, sf, max_steps=12)


def assembled_epoch(spark, sf):
    return _assembled(spark, sf)


def epoch_files(spark, sf):
    """A whole epoch written as batch files by worker, from stored segments, and read back."""
    r, chunks, path = _events(spark, sf), _train_chunks(spark, sf), storage.scratch_path(spark, "epoch")
    segs = windows.store_segments(r.norm, CFG.window.stride)
    plan = epochs.placed_plan(chunks, epoch=1, world=2, batch=16)
    epochs.write_epoch(plan, windows.training_windows(chunks, None, r.jobs, CFG.window, segs), path, 8)
    index = epochs.read_index(spark, path).select("rank", "step", "n_samples")
    return epochs.read_epoch(spark, path).join(index, ["rank", "step"]).select(
        "rank", "step", "pos", "job_id", "chunk_idx", "n_samples",
        F.md5(_digits(F.col("target"))).alias("target_md5"),
        F.md5(_digits(F.col("ctx")[3])).alias("ctx_3_md5"),
    )


# ── Scoring and evaluation ──────────────────────────────────────────────────
def windows_per_job(spark, sf):
    r = _events(spark, sf)
    fixed = scoring.windows_per_job(r.jobs, replace(CFG.window, max_windows=25))
    by_length = scoring.windows_per_job(
        r.jobs.drop("duration_sec"), replace(CFG.window, max_windows=None)
    )
    return (
        r.capped(r.jobs).withColumnRenamed("max_windows", "by_duration")
        .join(fixed.select("job_id", F.col("max_windows").alias("fixed")), "job_id")
        .join(by_length.select("job_id", F.col("max_windows").alias("by_length")), "job_id")
    )


def score_plan(spark, sf):
    r = _events(spark, sf)
    return scoring.score_plan(r.capped(r.jobs), CFG.window.w_pred)


def _scores(pairs):
    return _rounded(pairs, ("job_id", "k"), 5, gen_z="gen_z")


def score_carry(spark, sf):
    r = _events(spark, sf)
    return _scores(r.score(r.jobs, scoring.carry_predictor))


def score_linear(spark, sf):
    r = _events(spark, sf)
    return _scores(r.score(r.part("test"), scoring.linear_predictor(*r.line)))


def stratified_subsample(spark, sf):
    jobs = _large(spark, sf).jobs
    return split.stratified_subsample(jobs, 100, STRATA, CFG.split.seed).select("job_id")


def _watts(spark, sf):
    r = _events(spark, sf)
    return evaluate.in_watts(r.pairs, r.stats)


def denormalized_power(spark, sf):
    return _rounded(_watts(spark, sf), ("job_id", "k"), 3, real_w="real_w", gen_w="gen_w")


def _summary(spark, sf):
    return evaluate.trace_metrics(_watts(spark, sf), CFG.window.bin_sec)


def _summary_view(df):
    return _rounded(
        df, ("job_id", "length"), 5, pearson_r="pearson_r", rmse="rmse", mae="mae",
        duration_min="duration_min",
    )


def trace_metrics(spark, sf):
    return _summary_view(_summary(spark, sf))


def pearson_normalized(spark, sf):
    r = _events(spark, sf)
    stored = r.pairs.select("job_id", "k", "gen_z")
    pairs = evaluate.pair_with_truth(r.norm, stored)
    return _rounded(evaluate.pearson_normalized(pairs), ("job_id",), 5, pearson_r="pearson_r")


def attach_pearson(spark, sf):
    r = _events(spark, sf)
    stored = _summary(spark, sf).filter(F.col("job_id").cast("long") % 2 == 0)
    out = evaluate.attach_pearson(r.part("test"), stored, r.pairs)
    return _rounded(out, ("job_id",), 5, pearson_r="pearson_r")


def eval_headline(spark, sf):
    h = evaluate.headline(_summary(spark, sf))
    names = [c for c in h.columns if c != "n_jobs"]
    return _rounded(h, ("n_jobs",), 5, **{c: c for c in names})


def best_jobs(spark, sf):
    return _summary_view(evaluate.best_jobs(_summary(spark, sf), 6))


def worst_jobs(spark, sf):
    return _summary_view(evaluate.worst_jobs(_summary(spark, sf), 6))


def random_jobs(spark, sf):
    r = _events(spark, sf)
    out = evaluate.random_scored_jobs(r.jobs, r.pairs, _summary(spark, sf), 6, CFG.split.seed)
    return _rounded(out, ("job_id",), 5, pearson_r="pearson_r")


def trace_export(spark, sf):
    path = storage.scratch_path(spark, "export")
    tables.write_export(evaluate.trace_export(_watts(spark, sf), CFG.window.bin_sec), path)
    stored = (
        spark.read.option("header", True)
        .schema("timestamp_s double, real_power_W double, synthetic_power_W double, job_id string")
        .csv(path)
    )
    return _rounded(
        stored, ("job_id",), 3, timestamp_s="timestamp_s", real_power_W="real_power_W",
        synthetic_power_W="synthetic_power_W",
    )


def trace_captions(spark, sf):
    out = evaluate.trace_captions(_watts(spark, sf), _events(spark, sf).jobs, CFG.window.bin_sec)
    names = ("duration_min", "real_mean", "real_max", "gen_mean", "gen_max")
    return _rounded(out, ("job_id", "nodes_req"), 3, **{c: c for c in names})


def masked_window_loss(spark, sf):
    r = _events(spark, sf)
    slope, intercept = r.line
    test = r.chunks.filter(F.col("split") == "test")
    w = windows.training_windows(test, r.norm, r.jobs, CFG.window)
    pred = F.transform(F.col("future_aux")[0], lambda x: F.lit(intercept) + F.lit(slope) * x.cast("double"))
    out = evaluate.masked_loss(evaluate.packed_losses(w, pred, F.col("target"), F.col("pred_mask")), 1.0)
    return _rounded(out, ("n_windows", "n_skipped"), 6, loss="loss")


QUERIES = {
    f.__name__: f
    for f in (
        csv_ingest, tolerant_parse, scheduler_csv, trace_index_dedup, trace_sink_roundtrip,
        trace_index, packed_traces, split_sink_roundtrip, pending_units, fetch_plan, job_outcomes,
        phase_report,
        sampling_interval, rate_gate, gpu_rollup, job_t0, time_bins, node_grid_ffill,
        node_ratio_gate, cross_node_agg, job_grid_fill, trace_projection, resampled_traces,
        jobs_joined, cyclical_time, mem_sentinel, quantile_fit, quantile_normal, mem_req_scaled,
        node_features, cpus_req_scaled, duration_scaled, priority_scaled, priority_tier,
        one_hot_tier, job_type_onehot, state_onehot, job_features, feature_histograms,
        feature_correlation,
        required_columns, finite_jobs, split_random, split_stratified, split_coverage,
        stats_sample, norm_stats, normalized_traces, chunk_index, chunk_reindex,
        window_context, window_future, window_mask, window_cond, training_windows, epoch_plan,
        batch_layout, assembled_batches, assembled_epoch, epoch_files,
        windows_per_job, score_plan, score_carry, score_linear, stratified_subsample,
        denormalized_power, trace_metrics, pearson_normalized, attach_pearson, eval_headline,
        best_jobs, worst_jobs, random_jobs, trace_export, trace_captions, masked_window_loss,
    )
}
