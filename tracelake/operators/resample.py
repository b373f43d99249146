"""Raw samples to one dense four-channel trace per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.config import METRICS, SOURCE_METRICS, ResampleConfig
from tracelake.operators.coverage import NODE, bin_index, job_gate, kept_nodes, node_facts
from tracelake.operators.gapfill import (
    fences,
    fill,
    job_spans,
    node_spans,
    spread,
    summarize,
    with_block,
)

PARTITION = ("job_id", "blk")
_HOW = {c: how for c, _, how in METRICS}


def _combine():
    """Mean or sum per metric. A sum over nothing but missing values is 0."""
    return [
        (F.avg(c) if how == "mean" else F.coalesce(F.sum(c), F.lit(0.0))).alias(c)
        for c, _, how in METRICS
    ]


def locate(telemetry: DataFrame, nodes: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Samples of the kept nodes with their grid position.

    ``nodes`` carries ``t0``. The gates run before the samples are grouped, so
    rejected nodes and jobs never reach the shuffle below. A node may be joined in several parts by
    timestamp: where the join is not a broadcast, samples are laid out by node and part, and the
    rollup runs in that layout. Where ``nodes`` tells a node's samples (``n_rows``), it is one part, and
    more only beyond ``cfg.hot_rows``; such nodes are few, as all samples bound their number. Otherwise
    every node has ``cfg.node_parts``.
    """
    rows, keys = telemetry.filter(F.col("timestamp").isNotNull()), list(NODE)
    if "n_rows" not in nodes.columns:
        parts = F.sequence(F.lit(0), F.lit(cfg.node_parts - 1))
        rows = rows.withColumn("part", F.pmod(F.hash("timestamp"), F.lit(cfg.node_parts)))
        nodes, keys = nodes.withColumn("part", F.explode(parts)), [*keys, "part"]
    else:
        parts = F.greatest(F.ceil(F.coalesce("n_rows", F.lit(0)) / cfg.hot_rows), F.lit(1)).cast("int")
        hot = nodes.select(*NODE, parts.alias("_parts")).filter("_parts > 1")
        if not hot.isEmpty():
            part = F.pmod(F.hash("timestamp"), F.coalesce("_parts", F.lit(1)))
            rows = rows.join(F.broadcast(hot), keys, "left").withColumn("part", part)
            nodes, keys = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "part"]
    return rows.join(nodes, keys).select(*keys, "timestamp", bin_index(cfg).alias("k"), *SOURCE_METRICS)


def gpu_rollup(located: DataFrame) -> DataFrame:
    """Combine the GPUs that share a timestamp. Map-side partial aggregation applies."""
    part = [c for c in ("part",) if c in located.columns]
    return located.groupBy(*NODE, *part, "timestamp", "k").agg(*_combine()).drop(*part)


def bin_samples(rollup: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Mean per grid position. From here on rows stay distributed by (job, block)."""
    return (
        spread(with_block(rollup, cfg.block_bins), *PARTITION, parts=cfg.grid_parts)
        .groupBy(*NODE, "blk", "k")
        .agg(*[F.avg(c).alias(c) for c in SOURCE_METRICS])
    )


def spans_of_nodes(binned: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Block summaries of the nodes and what carries over between their blocks."""
    return node_spans(summarize(binned, NODE, SOURCE_METRICS), NODE, SOURCE_METRICS, cfg.block_bins)


def densify_nodes(binned: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Each node dense between its own first and last position, carried forward.

    Leading gaps of a metric stay NULL.
    """
    rows = fences(spans_of_nodes(binned, cfg), NODE, PARTITION, SOURCE_METRICS, cfg.block_bins, cfg.grid_parts)
    return fill(binned, rows, NODE, SOURCE_METRICS)


def combine_nodes(dense: DataFrame) -> DataFrame:
    """Mean or sum across the nodes present at each position of a job."""
    return dense.groupBy("job_id", "blk", "k").agg(*_combine())


def densify_jobs(cross: DataFrame, binned: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Each job dense from 0: forward fill, then back fill, then 0.

    ``binned`` are the node bins ``cross`` was made from; their summaries give the
    values that cross from block to block.
    """
    of_job = job_spans(spans_of_nodes(binned, cfg), NODE, "job_id", _HOW, cfg.block_bins)
    rows = fences(of_job, ("job_id",), PARTITION, SOURCE_METRICS, cfg.block_bins, cfg.grid_parts)
    return fill(cross, rows, ("job_id",), SOURCE_METRICS)


def finalize(dense: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """Relative time, output names and storage types."""
    return dense.select(
        "job_id",
        "k",
        (F.col("k") * F.lit(cfg.dt)).alias("timestamp"),
        *[F.col(src).cast("float").alias(out) for src, out, _ in METRICS],
    )


def resample_traces(
    telemetry: DataFrame,
    cfg: ResampleConfig,
    nodes: DataFrame | None = None,
    only_jobs: DataFrame | None = None,
    facts: DataFrame | None = None,
) -> DataFrame:
    """The whole chain. ``telemetry`` is parsed; see the source for its columns.

    ``nodes`` registers nodes whose file may be empty. ``only_jobs`` (job_id) limits
    the work to some jobs, for example those inside the duration bounds. ``facts``
    are the node facts when they are already stored.
    """
    facts = node_facts(telemetry, cfg, nodes) if facts is None else facts
    kept = kept_nodes(facts, job_gate(facts, cfg))
    if only_jobs is not None:
        kept = kept.join(only_jobs.select("job_id"), "job_id", "left_semi")
    binned = bin_samples(gpu_rollup(locate(telemetry, kept, cfg)), cfg)
    cross = combine_nodes(densify_nodes(binned, cfg))
    return finalize(densify_jobs(cross, binned, cfg), cfg)
