"""Window index and the training windows sliced from normalized traces.

Traces are packed into segments of ``stride`` bins. Segment i is the start of window
i, its context is the tail of the segments before it. A window therefore needs a few
neighbouring segments, not its job's whole trace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.config import FEATURES, WindowConfig
from tracelake.functions.expressions import ceil_div, int_div
from tracelake.operators.gapfill import spread
from tracelake.operators.normalize import POWER, Z_COLUMNS
from tracelake.storage import scratch_path


def chunk_index(jobs: DataFrame, stride: int) -> DataFrame:
    """``(split, job_id, chunk_idx)`` with max(1, ceil(length / stride)) rows per job.

    Works on freshly split jobs and, for a new stride, on a stored job table.
    """
    last = F.greatest(ceil_div(F.col("length"), stride), F.lit(1).cast("long")) - 1
    keys = [c for c in ("split", "job_id") if c in jobs.columns]
    return jobs.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_idx"))


def segments(norm: DataFrame, size: int) -> DataFrame:
    """``(job_id, seg, c0..c3)``: float arrays of up to ``size`` bins in time order."""
    packed = (
        norm.withColumn("seg", int_div(F.col("k"), F.lit(size)))
        .groupBy("job_id", "seg")
        .agg(F.sort_array(F.collect_list(F.struct("k", *Z_COLUMNS))).alias("rows"))
    )
    return packed.select(
        "job_id", "seg", *[F.col(f"rows.{z}").alias(f"c{i}") for i, z in enumerate(Z_COLUMNS)]
    )


def store_segments(norm: DataFrame, size: int, parts: int | None = None) -> DataFrame:
    """The segments as a table bucketed by job, for windows that are cut again and again.

    Traces are shuffled once, here; windows over the table, of any jobs and epochs, need no exchange of
    them. ``parts`` is the number of buckets, from the bins (``layout.tasks_of``).
    """
    spark = norm.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"segments_{uuid.uuid4().hex}"
    (
        segments(spread(norm, "job_id", parts=n), size)
        .write.bucketBy(n, "job_id").sortBy("job_id", "seg")
        .option("compression", "zstd").option("path", scratch_path(spark, "segments"))
        .saveAsTable(name)
    )
    return spark.table(name)


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))


def _pad_left(a: Column, width: int) -> Column:
    """Last ``width`` elements, zeros in front."""
    n = F.size(a)
    have = F.least(n, F.lit(width))
    return F.concat(_zeros(F.lit(width) - have), F.slice(a, n - have + 1, have))


def _pad_right(a: Column, width: int) -> Column:
    """First ``width`` elements, zeros behind."""
    kept = F.slice(a, F.lit(1), F.lit(width))
    return F.concat(kept, _zeros(F.lit(width) - F.size(kept)))


def cut_windows(segs: DataFrame, cfg: WindowConfig) -> DataFrame:
    """Context, future channels, target and mask of every window of every job."""
    back = -(-cfg.w_ctx // cfg.stride)
    ahead = -(-cfg.w_pred // cfg.stride) - 1
    order = Window.partitionBy("job_id").orderBy("seg")
    empty = F.array().cast("array<float>")

    def near(c: str, offset: int) -> Column:
        if offset == 0:
            return F.col(c)
        moved = F.lag(c, -offset) if offset < 0 else F.lead(c, offset)
        return F.coalesce(moved.over(order), empty)

    names = [f"c{i}" for i in range(len(Z_COLUMNS))]
    gathered = segs.select(
        "job_id",
        F.col("seg").alias("chunk_idx"),
        *[F.concat(*[near(c, -j) for j in range(back, 0, -1)]).alias(f"p_{c}") for c in names],
        *[F.concat(*[near(c, j) for j in range(0, ahead + 1)]).alias(f"f_{c}") for c in names],
    )
    power = names[POWER]
    real = F.least(F.size(f"f_{power}"), F.lit(cfg.w_pred))
    one = F.lit(1.0).cast("float")
    return gathered.select(
        "job_id",
        "chunk_idx",
        F.array(*[_pad_left(F.col(f"p_{c}"), cfg.w_ctx) for c in names]).alias("ctx"),
        F.array(
            *[_pad_right(F.col(f"f_{c}"), cfg.w_pred) for c in names if c != power]
        ).alias("future_aux"),
        _pad_right(F.col(f"f_{power}"), cfg.w_pred).alias("target"),
        F.concat(
            F.array_repeat(one, real.cast("int")), _zeros(F.lit(cfg.w_pred) - real)
        ).alias("pred_mask"),
    )


def conditioning(jobs: DataFrame) -> DataFrame:
    """``(job_id, cond)``: the 24 features as floats in declared order."""
    return jobs.select(
        "job_id", F.array(*[F.col(c).cast("float") for c in FEATURES]).alias("cond")
    )


def training_windows(
    chunks: DataFrame, norm: DataFrame, jobs: DataFrame, cfg: WindowConfig, segs: DataFrame | None = None
) -> DataFrame:
    """Windows named by ``chunks`` with the conditioning vector of their job.

    Grid rows of jobs outside ``chunks`` are dropped first; the rest is shuffled once,
    by job, for packing, windowing and the join alike. Jobs are those of the index, so
    the duration bound limits what lies together. The result holds about
    (w_ctx + w_pred) / stride copies of the traces; write it only when needed. ``segs`` are stored
    segments of ``stride`` bins (``store_segments``), which take the place of ``norm``.
    """
    wanted = chunks.groupBy("job_id").agg(F.collect_set("chunk_idx").alias("_wanted"))
    per_job = conditioning(jobs).join(wanted, "job_id")
    if segs is None:
        kept = norm.join(wanted.select("job_id"), "job_id", "left_semi")
        segs = segments(spread(kept, "job_id"), cfg.stride)
    windows = cut_windows(segs, cfg)
    return (
        windows.join(per_job, "job_id")
        .filter(F.array_contains("_wanted", F.col("chunk_idx")))
        .drop("_wanted")
    )
