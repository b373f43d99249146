"""Pipeline parameters. Field defaults are the shipped production values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Source column, output column, aggregation across GPUs and nodes.
METRICS = (
    ("utilization_gpu_pct", "gpu_used_pct", "mean"),
    ("utilization_memory_pct", "memory_used_pct", "mean"),
    ("memory_used_MiB", "memory_used_MiB", "sum"),
    ("power_draw_W", "power_draw_W", "sum"),
)
SOURCE_METRICS = tuple(m[0] for m in METRICS)

# Channel order of a trace and the normalization of each channel.
CHANNELS = (
    ("gpu_used_pct", "linear_pct"),
    ("memory_used_pct", "linear_pct"),
    ("memory_used_MiB", "log1p_zscore"),
    ("power_draw_W", "log1p_zscore"),
)
CHANNEL_NAMES = tuple(c[0] for c in CHANNELS)
LOG_CHANNELS = tuple(c for c, n in CHANNELS if n == "log1p_zscore")
NORM_NAMES = ("linear_pct", "log1p_zscore")

# The 24 conditioning features in their declared order.
FEATURES = (
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "mem_unlimited", "mem_req_scaled", "nodes_req_is_one", "nodes_req_log",
    "cpus_req_scaled", "duration_scaled", "priority_scaled",
    "ptier_0", "ptier_1", "ptier_2",
    "type_batch", "type_interactive", "type_map", "type_other",
    "state_other", "state_3", "state_4", "state_5", "state_6", "state_11",
)


@dataclass(frozen=True)
class ResampleConfig:
    dt: float = 0.103
    probe_rows: int = 50
    dt_min: float = 0.001
    dt_max: float = 0.300
    min_node_keep_ratio: float = 0.75
    lower_sec: float = 300.0
    upper_sec: float = 7200.0
    # Bins per time block: the unit of work, so that one long job spans many tasks.
    block_bins: int = 4096
    # A node with more samples is joined and rolled up in several parts, by timestamp.
    hot_rows: int = 5_000_000
    # Parts of every node where the samples of nodes are not known. The table of kept nodes is
    # copied so many times.
    node_parts: int = 8
    # Partitions of the dense grid; the session's number where it is not derived from facts.
    grid_parts: int | None = None


@dataclass(frozen=True)
class FeatureConfig:
    # Thresholds, periods, category lists and quantile counts.
    hour_period: float = 24.0
    dow_period: float = 7.0
    dom_period: float = 31.0
    mem_unlimited_threshold: float = 1e9
    nodes_log_denominator: float = 8.0
    tier_thresholds: tuple = (11000.0, 20000.0)
    keep_states: tuple = (3, 4, 5, 6, 11)
    job_type_map: tuple = (
        ("LLMAPREDUCE:MAP", "map"),
        ("LLSUB:BATCH", "batch"),
        ("LLSUB:INTERACTIVE", "interactive"),
        ("OTHER", "other"),
    )
    type_categories: tuple = ("batch", "interactive", "map", "other")
    mem_quantiles: int = 500
    cpus_quantiles: int = 200
    duration_quantiles: int = 1000
    priority_quantiles: int = 500


@dataclass(frozen=True)
class SplitConfig:
    test_frac: float = 0.10
    seed: int = 42
    stratify_cols: tuple = ()


@dataclass(frozen=True)
class NormConfig:
    clip_lo: float = -10.0
    clip_hi: float = 10.0
    min_std: float = 1e-6
    stats_sample_frac: float | None = None


@dataclass(frozen=True)
class WindowConfig:
    w_ctx: int = 16384
    w_pred: int = 8192
    stride: int = 8192
    bin_sec: float = 0.103
    max_windows: int | None = 25


@dataclass(frozen=True)
class PipelineConfig:
    resample: ResampleConfig = field(default_factory=ResampleConfig)
    features: FeatureConfig = field(default_factory=FeatureConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    norm: NormConfig = field(default_factory=NormConfig)
    window: WindowConfig = field(default_factory=WindowConfig)
