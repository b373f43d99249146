"""Scores of generated traces against measured ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.expressions import is_finite
from tracelake.operators.normalize import ChannelStats
from tracelake.operators.quantiles import exact_medians
from tracelake.operators.split import random_jobs


def pair_with_truth(norm: DataFrame, synth: DataFrame) -> DataFrame:
    """``(job_id, k, real_z, gen_z)`` over the generated length of stored traces."""
    truth = norm.select("job_id", "k", F.col("z3").cast("double").alias("real_z"))
    return synth.select("job_id", "k", F.col("gen_z").cast("double").alias("gen_z")).join(
        truth, ["job_id", "k"]
    ).select("job_id", "k", "real_z", "gen_z")


def in_watts(pairs: DataFrame, stats: ChannelStats) -> DataFrame:
    return pairs.select(
        "job_id",
        "k",
        stats.denormalized(F.col("real_z")).alias("real_w"),
        stats.denormalized(F.col("gen_z")).alias("gen_w"),
    )


def _pearson(a: str, b: str, threshold: float, inclusive: bool) -> Column:
    """Undefined when either population deviation is at or below the threshold."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    t = F.lit(threshold)
    defined = ((sa > t) & (sb > t)) if inclusive else ((sa >= t) & (sb >= t))
    return F.when(defined, F.try_divide(F.covar_pop(a, b), sa * sb))


def trace_metrics(watts: DataFrame, bin_sec: float, jobs: DataFrame | None = None) -> DataFrame:
    """Per job: Pearson r, RMSE and MAE in watts, length and minutes of ``bin_sec`` bins.

    With ``jobs`` (job_id) a job without any generated bin still gets a row, with
    undefined scores and length 0.
    """
    diff = F.col("real_w") - F.col("gen_w")
    out = watts.groupBy("job_id").agg(
        _pearson("real_w", "gen_w", 1e-9, inclusive=False).alias("pearson_r"),
        F.sqrt(F.avg(diff * diff)).alias("rmse"),
        F.avg(F.abs(diff)).alias("mae"),
        F.count(F.lit(1)).alias("length"),
    )
    if jobs is not None:
        out = jobs.select("job_id").join(out, "job_id", "left").withColumn(
            "length", F.coalesce("length", F.lit(0).cast("long"))
        )
    return out.withColumn("duration_min", F.col("length") * F.lit(bin_sec) / F.lit(60.0))


def pearson_normalized(pairs: DataFrame) -> DataFrame:
    """``(job_id, pearson_r)`` in normalized space."""
    return pairs.groupBy("job_id").agg(
        _pearson("real_z", "gen_z", 1e-8, inclusive=True).alias("pearson_r")
    )


def attach_pearson(jobs: DataFrame, stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored r where there is one, else the normalized-space r of the job's pairs.

    Only the jobs without a stored value have their bins read.
    """
    known = stored.filter(F.col("pearson_r").isNotNull()).select("job_id", "pearson_r")
    todo = jobs.select("job_id").join(known.select("job_id"), "job_id", "left_anti")
    computed = pearson_normalized(pairs.join(todo, "job_id", "left_semi"))
    filled = known.unionByName(computed)
    return jobs.select("job_id").join(filled, "job_id", "left")


def headline(summary: DataFrame, threshold: float = 0.30) -> DataFrame:
    """One row: mean and median r and the share above the threshold over defined r,
    mean and median RMSE and MAE over all jobs, and the job count.

    Medians come from the exact quantile table, which no single task sorts.
    """
    score = F.when(is_finite(F.col("pearson_r")), F.col("pearson_r"))
    clean = summary.withColumn("pearson_r", score)
    medians = exact_medians(clean, ["pearson_r", "rmse", "mae"]).agg(
        *[
            F.max(F.when(F.col("column_name") == c, F.col("median"))).alias(f"{c}_median")
            for c in ("pearson_r", "rmse", "mae")
        ]
    )
    means = clean.agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.avg("pearson_r").alias("pearson_r_mean"),
        F.avg(F.when(score.isNotNull(), (score > threshold).cast("double"))).alias("share_above"),
        F.avg("rmse").alias("rmse_mean"),
        F.avg("mae").alias("mae_mean"),
    )
    return merge_rows(means, medians)


def merge_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row tables with different columns as one row."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def best_jobs(summary: DataFrame, k: int) -> DataFrame:
    return _ranked(summary, F.col("pearson_r").desc(), k)


def worst_jobs(summary: DataFrame, k: int) -> DataFrame:
    return _ranked(summary, F.col("pearson_r").asc(), k)


def _ranked(summary: DataFrame, order: Column, k: int) -> DataFrame:
    """Top-k report over defined scores, ties by job id."""
    return summary.filter(is_finite(F.col("pearson_r"))).orderBy(order, "job_id").limit(k)


def random_scored_jobs(
    jobs: DataFrame, synth: DataFrame, summary: DataFrame, k: int, seed: int
) -> DataFrame:
    """k reproducible jobs among those with generated output, with their r."""
    available = jobs.select("job_id").join(
        synth.select("job_id").distinct(), "job_id", "left_semi"
    )
    picked = random_jobs(available, k, seed)
    return picked.join(summary.select("job_id", "pearson_r"), "job_id", "left")


def trace_export(watts: DataFrame, bin_sec: float) -> DataFrame:
    return watts.select(
        "job_id",
        "k",
        (F.col("k") * F.lit(bin_sec)).alias("timestamp_s"),
        F.col("real_w").alias("real_power_W"),
        F.col("gen_w").alias("synthetic_power_W"),
    )


def trace_captions(watts: DataFrame, jobs: DataFrame, bin_sec: float) -> DataFrame:
    """Facts printed above a trace plot: minutes, nodes, mean and peak watts."""
    facts = watts.groupBy("job_id").agg(
        (F.count(F.lit(1)) * F.lit(bin_sec) / F.lit(60.0)).alias("duration_min"),
        F.avg("real_w").alias("real_mean"),
        F.max("real_w").alias("real_max"),
        F.avg("gen_w").alias("gen_mean"),
        F.max("gen_w").alias("gen_max"),
    )
    if "nodes_req" not in jobs.columns:
        return facts.withColumn("nodes_req", F.lit(1).cast("long"))
    nodes = F.coalesce(F.col("nodes_req").cast("long"), F.lit(1).cast("long"))
    return facts.join(jobs.select("job_id", "nodes_req"), "job_id", "left").withColumn(
        "nodes_req", nodes
    )


def window_losses(bins: DataFrame) -> DataFrame:
    """Masked mean squared error per window from ``(job_id, chunk_idx, pred, target, mask)``."""
    diff = F.col("pred") - F.col("target")
    return bins.groupBy("job_id", "chunk_idx").agg(
        (F.sum(F.col("mask") * diff * diff) / F.greatest(F.sum("mask"), F.lit(1.0))).alias("loss")
    )


def packed_losses(windows: DataFrame, pred: Column, target: Column, mask: Column) -> DataFrame:
    """The same from arrays, one row per window: no bin becomes a row and nothing is shuffled."""
    square = F.zip_with(pred, target, lambda p, t: (p - t.cast("double")) * (p - t.cast("double")))
    masked = F.zip_with(square, mask, lambda e, m: e * m.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
    loss = total(masked) / F.greatest(total(mask), F.lit(1.0))
    return windows.select("job_id", "chunk_idx", loss.alias("loss"))


def masked_loss(losses: DataFrame, threshold: float) -> DataFrame:
    """One row: mean over all windows with outliers counted as 0, and their number."""
    bad = ~is_finite(F.col("loss")) | (F.col("loss") > threshold)
    bad = F.coalesce(bad, F.lit(True))
    return losses.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(bad).alias("n_skipped"),
        F.avg(F.when(bad, F.lit(0.0)).otherwise(F.col("loss"))).alias("loss"),
    )
