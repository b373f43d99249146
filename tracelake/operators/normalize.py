"""Train-only normalization statistics and the normalized channels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.config import CHANNELS, LOG_CHANNELS, NORM_NAMES, NormConfig
from tracelake.functions.expressions import clip
from tracelake.operators import moments
from tracelake.storage import materialize

Z_COLUMNS = tuple(f"z{i}" for i in range(len(CHANNELS)))
POWER = len(CHANNELS) - 1


def fit_norm(traces: DataFrame, jobs: DataFrame, cfg: NormConfig) -> DataFrame:
    """Rows ``(channel, norm, log_mean, log_std)`` fitted on the given jobs only.

    Moments are first taken per job, on the map side as far as possible, so the restriction to
    ``jobs`` joins one row per job instead of every grid row. Jobs are merged by centred moments.
    Linear channels carry 0 and 1. Fails when a log channel has no data.
    """
    logs = {c: _log(c) for c in LOG_CHANNELS}
    per_job = moments.per_group(traces, ("job_id",), logs)
    fitted = moments.merged(
        materialize(per_job.join(jobs.select("job_id"), "job_id", "left_semi"), "job-moments"), LOG_CHANNELS
    )
    rows = []
    for channel, norm in CHANNELS:
        mean, std = 0.0, 1.0
        if norm == "log1p_zscore":
            if not fitted.n[channel]:
                raise ValueError(f"no data for channel {channel}")
            mean = fitted.mean[channel]
            std = math.sqrt(max(fitted.m2[channel] / fitted.n[channel], cfg.min_std**2))
        rows.append((channel, norm, mean, std))
    return traces.sparkSession.createDataFrame(rows, "channel string, norm string, log_mean double, log_std double")


def _log(channel: str) -> Column:
    return F.log1p(F.col(channel).cast("double"))


@dataclass(frozen=True)
class ChannelStats:
    """The four-row statistics table as plan literals."""

    by_channel: dict[str, tuple[str, float, float]]

    @classmethod
    def from_table(cls, stats: DataFrame) -> "ChannelStats":
        rows = stats.collect()
        unknown = sorted({r["norm"] for r in rows} - set(NORM_NAMES))
        if unknown:
            raise ValueError(f"unknown_norm:{','.join(unknown)}")
        return cls({r["channel"]: (r["norm"], r["log_mean"], r["log_std"]) for r in rows})

    def scaled(self, channel: str) -> Column:
        """Normalized value in double, before clipping."""
        norm, mean, std = self.by_channel[channel]
        x = F.col(channel).cast("double")
        if norm == "linear_pct":
            return (x / F.lit(100.0)) * F.lit(2.0) - F.lit(1.0)
        return (F.log1p(x) - F.lit(mean)) / F.lit(std)

    def denormalized(self, z: Column, channel: str = CHANNELS[POWER][0]) -> Column:
        """Back to watts (or the channel's unit) from normalized space."""
        _, mean, std = self.by_channel[channel]
        return F.expm1(z.cast("double") * F.lit(std) + F.lit(mean))


def normalize(traces: DataFrame, stats: ChannelStats, cfg: NormConfig) -> DataFrame:
    """``(job_id, k, z0..z3)`` as stored floats. A projection: no join, no shuffle."""
    return traces.select(
        "job_id",
        "k",
        *[
            clip(stats.scaled(channel), cfg.clip_lo, cfg.clip_hi).cast("float").alias(z)
            for z, (channel, _) in zip(Z_COLUMNS, CHANNELS)
        ],
    )


def pack(norm: DataFrame, index: DataFrame, max_length: int) -> DataFrame:
    """One row per indexed job: ``(job_id, length, ch)`` with ``ch`` channel by time.

    Only jobs of the index are packed, and their duration bound limits an array to
    ``max_length`` bins. A bin beyond it is an error before anything is collected,
    never a silent cut.
    """
    beyond = F.raise_error(F.concat(F.lit("trace exceeds the duration bound: "), F.col("job_id")))
    bounded = F.when(F.col("k") >= max_length, beyond.cast("long")).otherwise(F.col("k"))
    kept = norm.join(index.select("job_id"), "job_id", "left_semi").withColumn("k", bounded)
    packed = kept.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("length"),
        F.sort_array(F.collect_list(F.struct("k", *Z_COLUMNS))).alias("rows"),
    )
    return packed.select(
        "job_id", "length", F.array(*[F.col(f"rows.{z}") for z in Z_COLUMNS]).alias("ch")
    )


def attach_lengths(jobs: DataFrame, norm: DataFrame) -> DataFrame:
    """Jobs that have a normalized trace, with the measured length replacing any other."""
    measured = norm.groupBy("job_id").agg(F.count(F.lit(1)).alias("length"))
    return jobs.drop("length").join(measured, "job_id")
