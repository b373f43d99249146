"""Windowed autoregressive scoring with a pluggable predictor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.config import WindowConfig
from tracelake.functions.expressions import ceil_div
from tracelake.operators import moments
from tracelake.operators.gapfill import spread
from tracelake.operators.rowid import with_ordered_row_id
from tracelake.operators.windows import segments
from tracelake.storage import materialize

# (context 4 x w_ctx, future channels 3 x w_pred, conditioning) -> w_pred values
Predictor = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def windows_per_job(jobs: DataFrame, cfg: WindowConfig) -> DataFrame:
    """``(job_id, length, max_windows)``: a fixed cap, or what the duration needs.

    Without a duration the length decides.
    """
    if cfg.max_windows is not None:
        cap: Column = F.lit(cfg.max_windows).cast("long")
    else:
        by_length = ceil_div(F.col("length"), cfg.w_pred)
        cap = by_length
        if "duration_sec" in jobs.columns:
            span = F.lit(cfg.w_pred * cfg.bin_sec)
            by_duration = F.ceil(F.col("duration_sec").cast("double") / span)
            known = F.col("duration_sec").isNotNull() & ~F.isnan(F.col("duration_sec"))
            cap = F.when(known, by_duration).otherwise(by_length)
        cap = F.greatest(cap, F.lit(1).cast("long"))
    return jobs.select("job_id", "length", cap.alias("max_windows"))


def score_plan(capped: DataFrame, w_pred: int) -> DataFrame:
    """``(job_id, w, start, n_real)``: one row per window to generate."""
    total = F.least(F.col("length"), F.col("max_windows") * w_pred)
    return (
        capped.select("job_id", total.alias("total"))
        .filter(F.col("total") > 0)
        .select(
            "job_id",
            "total",
            F.explode(
                F.sequence(F.lit(0).cast("long"), ceil_div(F.col("total"), w_pred) - 1)
            ).alias("w"),
        )
        .select(
            "job_id",
            "w",
            (F.col("w") * w_pred).alias("start"),
            F.least(F.lit(w_pred).cast("long"), F.col("total") - F.col("w") * w_pred).alias("n_real"),
        )
    )


def deal_jobs(plan: DataFrame, tasks: int) -> DataFrame:
    """``(job_id, task)``: jobs dealt to tasks by their planned windows, longest first, there and back."""
    sized = plan.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    falling = F.concat(F.lpad((F.lit(10**9) - F.col("n")).cast("string"), 10, "0"), F.lit("|"), F.col("job_id"))
    numbered = with_ordered_row_id(sized.select("job_id", falling.alias("place")), "place")
    turn = F.col("row_id") % (2 * tasks)
    return numbered.select("job_id", F.least(turn, F.lit(2 * tasks - 1) - turn).cast("int").alias("task"))


def score_jobs(
    norm: DataFrame, plan: DataFrame, cond: DataFrame, predictor: Predictor, cfg: WindowConfig
) -> DataFrame:
    """``(job_id, w, start, real, gen, error)``: generated power per planned window.

    Jobs are independent, windows of a job follow each other. Each partition streams
    its windows in (job, window) order and keeps only the last ``w_ctx`` bins of the
    job at hand, so memory does not grow with a trace. A window the predictor cannot
    handle yields a row with ``error``, and the rest of that job is skipped.
    """
    w_ctx, w_pred = cfg.w_ctx, cfg.w_pred
    totals = plan.groupBy("job_id").agg(F.max(F.col("start") + F.col("n_real")).alias("total"))
    kept = norm.join(totals, "job_id").filter(F.col("k") < F.col("total")).drop("total")
    # The predictor dominates, so packed segments go to the task that their job is dealt to, not to the
    # one that its hash names: jobs differ in length.
    tasks = int(norm.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = deal_jobs(materialize(plan.select("job_id"), "scored-windows"), tasks).join(cond, "job_id", "left")
    rows = (
        segments(spread(kept, "job_id"), w_pred)
        .join(dealt, "job_id")
        .select(
            "job_id", F.col("seg").alias("w"), (F.col("seg") * w_pred).alias("start"),
            "c0", "c1", "c2", "c3", "cond", "task",
        )
        .repartitionById(tasks, "task")
        .drop("task")
        .sortWithinPartitions("job_id", "w")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, ctx, failed = None, None, False
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.job_id != job:
                    job, ctx, failed = r.job_id, np.zeros((4, w_ctx)), False
                if failed:
                    continue
                try:
                    if r.cond is None:
                        raise ValueError("no conditioning vector")
                    real = np.stack([np.asarray(c, np.float64) for c in (r.c0, r.c1, r.c2, r.c3)])
                    n = real.shape[1]
                    if not np.isfinite(real).all():
                        raise ValueError(f"shape or value: {real.shape}")
                    aux = np.zeros((3, w_pred))
                    aux[:, :n] = real[:3]
                    y = np.asarray(predictor(ctx, aux, np.asarray(r.cond, np.float64)), np.float64)
                    if y.shape != (w_pred,):
                        raise ValueError(f"prediction shape {y.shape}")
                except Exception as exc:  # reported as data, the partition goes on
                    failed = True
                    out.append((r.job_id, r.w, r.start, None, None, f"{type(exc).__name__}: {exc}"))
                    continue
                gen = y[:n]
                step = np.vstack([real[:3], gen])
                ctx = np.concatenate([ctx, step], axis=1)[:, -w_ctx:]
                out.append((r.job_id, r.w, r.start, real[3], gen, None))
            yield pd.DataFrame(out, columns=["job_id", "w", "start", "real", "gen", "error"])

    return rows.mapInPandas(
        run,
        "job_id string, w long, start long, real array<double>, gen array<double>, error string",
    )


def unpack_scores(scored: DataFrame) -> DataFrame:
    """``(job_id, k, real_z, gen_z)`` of the jobs that went through entirely.

    Reads ``scored`` twice, so pass a written table, as a scoring run leaves one.
    """
    failed = score_failures(scored).select("job_id").distinct()
    good = scored.join(failed, "job_id", "left_anti")
    return good.withColumn("_pairs", F.arrays_zip("real", "gen")).select(
        "job_id", "start", F.posexplode("_pairs").alias("pos", "pair")
    ).select(
        "job_id",
        (F.col("start") + F.col("pos")).alias("k"),
        F.col("pair.real").alias("real_z"),
        F.col("pair.gen").alias("gen_z"),
    )


def score_failures(scored: DataFrame) -> DataFrame:
    """``(job_id, w, error)`` of the jobs that stopped early."""
    return scored.filter(F.col("error").isNotNull()).select("job_id", "w", "error")


def _carry() -> Predictor:
    # A nested function travels to the workers by value, so they need no copy of this
    # package; a predictor from your own module must be importable there.
    def predict(ctx: np.ndarray, aux: np.ndarray, cond: np.ndarray) -> np.ndarray:
        return 0.5 * aux[0] + 0.5 * ctx[3, -1]

    return predict


# Half the first channel plus half the last generated value.
carry_predictor = _carry()


def linear_predictor(slope: float, intercept: float) -> Predictor:
    """Power as a straight line in the first channel."""

    def predict(ctx: np.ndarray, aux: np.ndarray, cond: np.ndarray) -> np.ndarray:
        return intercept + slope * aux[0]

    return predict


def fit_linear(norm: DataFrame, train: DataFrame) -> DataFrame:
    """One row ``(slope, intercept)`` of power on the first channel over train bins.

    Moments are taken per job first, so only one row per job meets the job list; jobs are merged by
    centred moments.
    """
    columns = {"x": F.col("z0").cast("double"), "y": F.col("z3").cast("double")}
    per_job = moments.per_group(norm, ("job_id",), columns, [("x", "y")])
    known = materialize(per_job.join(train.select("job_id"), "job_id", "left_semi"), "line-moments")
    m = moments.merged(known, columns, [("x", "y")])
    slope = m.c["x", "y"] / m.m2["x"] if m.m2["x"] > 0 else None
    line = (slope, None if slope is None else m.mean["y"] - slope * m.mean["x"])
    return norm.sparkSession.createDataFrame([line], "slope double, intercept double")
