"""Scheduler records joined with the trace index, and the 24 numeric job features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.config import FeatureConfig
from tracelake.functions.expressions import int_div
from tracelake.operators.quantiles import QuantileNormal

_DAY = 86400
# Epoch seconds a nanosecond timestamp can hold; others are treated as missing.
_EPOCH_LIMIT = 9223372036
RAW_COLUMNS = (
    "time_start", "mem_req", "cpus_req", "priority", "priority_tier_raw", "job_type", "state",
)


def select_scheduler(raw: DataFrame) -> DataFrame:
    """Used columns of the accounting records, with the job key as text."""
    return raw.select(
        F.col("id_job").cast("string").alias("job_id"),
        "cpus_req",
        "mem_req",
        "priority",
        "state",
        "job_type",
        "time_start",
    )


def select_index(index: DataFrame) -> DataFrame:
    """Used columns of the trace index without duplicate rows."""
    return (
        index.select("job_id", "file_path", "nodes_used", "duration_sec", "length")
        .dropDuplicates()
        .withColumnRenamed("nodes_used", "nodes_req")
    )


def join_jobs(scheduler: DataFrame, index: DataFrame) -> DataFrame:
    """Jobs present on both sides."""
    return scheduler.join(index, "job_id")


def require_rows(df: DataFrame) -> DataFrame:
    """Fail when nothing is left to work on."""
    if df.isEmpty():
        raise ValueError("no job is present in both the scheduler records and the trace index")
    return df


def epoch_seconds(c: Column) -> Column:
    """Epoch seconds as a long; values that are no valid time become NULL."""
    v = c.try_cast("bigint")
    return F.when(F.abs(v) <= _EPOCH_LIMIT, v)


def cyclical_columns(time_start: Column, cfg: FeatureConfig) -> dict[str, Column]:
    """Sine and cosine of hour, weekday (Monday = 0) and day of month, in UTC.

    Worked out from the epoch, so the session time zone has no influence.
    """
    t = epoch_seconds(time_start)
    second = F.pmod(t, F.lit(_DAY))
    days = F.floor(t / F.lit(_DAY))
    hour = int_div(second, F.lit(3600)) + int_div(F.pmod(second, F.lit(3600)), F.lit(60)) / 60.0
    dow = F.pmod(days + 3, F.lit(7))
    dom = F.dayofmonth(F.date_from_unix_date(days.cast("int"))) - 1
    parts = (
        ("hour", hour, cfg.hour_period), ("dow", dow, cfg.dow_period), ("dom", dom, cfg.dom_period),
    )
    out = {}
    for name, raw, period in parts:
        angle = F.lit(2.0 * math.pi) * raw / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def memory_columns(cfg: FeatureConfig) -> dict[str, Column]:
    """Sentinel flag, and the request with sentinel values missing."""
    limit = F.lit(cfg.mem_unlimited_threshold)
    return {
        "mem_unlimited": F.coalesce(F.col("mem_req") >= limit, F.lit(False)).cast("int"),
        "mem_known": F.when(F.col("mem_req") < limit, F.col("mem_req")),
    }


def node_columns(cfg: FeatureConfig) -> dict[str, Column]:
    n = F.col("nodes_req")
    return {
        "nodes_req_is_one": F.coalesce(n == 1, F.lit(False)).cast("int"),
        "nodes_req_log": F.when(
            n > 1, F.log2(n.cast("double")) / F.lit(cfg.nodes_log_denominator)
        ).otherwise(F.lit(0.0)),
    }


def priority_tier(c: Column, thresholds) -> Column:
    """Index of the first threshold above the value, else the number of thresholds."""
    expr = F.lit(len(thresholds))
    for i, t in reversed(list(enumerate(thresholds))):
        expr = F.when(c < F.lit(float(t)), F.lit(i)).otherwise(expr)
    return expr


def one_hot(c: Column, categories: dict[str, object]) -> dict[str, Column]:
    """0/1 column per declared category; a missing value is 0 everywhere."""
    return {
        name: F.coalesce(c == F.lit(value), F.lit(False)).cast("int")
        for name, value in categories.items()
    }


def job_type_label(c: Column, cfg: FeatureConfig) -> Column:
    """Known job types to their label; unknown ones become NULL."""
    expr = F.lit(None).cast("string")
    for raw, label in cfg.job_type_map:
        expr = F.when(c == raw, F.lit(label)).otherwise(expr)
    return expr


def state_bucket(c: Column, cfg: FeatureConfig) -> Column:
    """Kept states as they are, everything else -1."""
    return F.when(c.isin(*cfg.keep_states), c).otherwise(F.lit(-1))


def category_columns(cfg: FeatureConfig) -> dict[str, Column]:
    tier = priority_tier(F.col("priority"), cfg.tier_thresholds)
    tiers = {f"ptier_{i}": i for i in range(len(cfg.tier_thresholds) + 1)}
    types = {f"type_{t}": t for t in cfg.type_categories}
    states = {"state_other": -1, **{f"state_{s}": s for s in cfg.keep_states}}
    return {
        **one_hot(tier, tiers),
        **one_hot(job_type_label(F.col("job_type"), cfg), types),
        **one_hot(state_bucket(F.col("state"), cfg), states),
    }


def scaling_inputs(joined: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """The four columns the quantile transform is fitted on, beside the joined rows."""
    return joined.withColumns(
        {
            **memory_columns(cfg),
            "cpus_log": F.log2(F.col("cpus_req").cast("double") + 1.0),
            "duration_log": F.log1p(F.col("duration_sec")),
            "priority_log": F.when(F.col("priority") > 0, F.log10(F.col("priority").cast("double"))),
        }
    )


def scaling_targets(cfg: FeatureConfig) -> dict[str, int]:
    return {
        "mem_known": cfg.mem_quantiles,
        "cpus_log": cfg.cpus_quantiles,
        "duration_log": cfg.duration_quantiles,
        "priority_log": cfg.priority_quantiles,
    }


# Input of the transform, its output, and what a missing input turns into.
SCALED = (
    ("mem_known", "mem_req_scaled", 0.0),
    ("cpus_log", "cpus_req_scaled", None),
    ("duration_log", "duration_scaled", None),
    ("priority_log", "priority_scaled", None),
)


def fit_scaling(
    joined: DataFrame, cfg: FeatureConfig, fit_on: DataFrame | None = None
) -> QuantileNormal:
    """Fit on all joined jobs, or only on those listed in ``fit_on`` (job_id)."""
    rows = joined if fit_on is None else joined.join(fit_on.select("job_id"), "job_id", "left_semi")
    return QuantileNormal.fit(scaling_inputs(rows, cfg), scaling_targets(cfg))


def scale_columns(inputs: DataFrame, model: QuantileNormal) -> DataFrame:
    for source, output, missing in SCALED:
        inputs = model.transform(inputs, source, output)
        if missing is not None:
            inputs = inputs.withColumn(output, F.coalesce(F.col(output), F.lit(missing)))
    return inputs


def build_features(
    joined: DataFrame, cfg: FeatureConfig, model: QuantileNormal | None = None
) -> DataFrame:
    """The job feature table: identifiers, the 24 features and ``dom_*``.

    Without a model one is fitted on all joined jobs.
    """
    model = fit_scaling(joined, cfg) if model is None else model
    scaled = scale_columns(scaling_inputs(joined, cfg), model)
    return scaled.withColumns(
        {
            **cyclical_columns(F.col("time_start"), cfg),
            **node_columns(cfg),
            **category_columns(cfg),
        }
    ).drop(*RAW_COLUMNS, *[source for source, _, _ in SCALED])
