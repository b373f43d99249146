"""Views of the given tables in the shapes the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.config import (
    NormConfig,
    PipelineConfig,
    ResampleConfig,
    SplitConfig,
    WindowConfig,
)

# One-hour bins over a 30-day event log; windows scaled to the shorter series.
CONFIG = PipelineConfig(
    resample=ResampleConfig(
        dt=3600.0,
        probe_rows=10,
        dt_min=100000.0,
        dt_max=250000.0,
        min_node_keep_ratio=0.75,
        lower_sec=2400000.0,
        upper_sec=2580000.0,
        block_bins=256,
    ),
    split=SplitConfig(test_frac=0.10, seed=42),
    norm=NormConfig(),
    window=WindowConfig(w_ctx=128, w_pred=64, stride=64, bin_sec=3600.0),
)
# Bounds and geometry of the large index below, as shipped.
LARGE = PipelineConfig(resample=ResampleConfig(lower_sec=300.0, upper_sec=2000.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_keys():
    return [
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_type").alias("node_id"),
        F.col("event_id").alias("seq"),
    ]


def _event_values():
    return [
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        (F.col("event_id") % 101).cast("double").alias("utilization_gpu_pct"),
        F.get_json_object("props", "$.k").cast("double").alias("utilization_memory_pct"),
        (F.col("value") * F.lit(16.0)).alias("memory_used_MiB"),
        F.col("value").alias("power_draw_W"),
    ]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples from ``events``: a job per user, a node per event type."""
    return table(spark, sf_dir, "events").select(*_event_keys(), *_event_values())


def dirty_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same samples as text with unparseable cells sprinkled in."""
    e = telemetry(spark, sf_dir)
    return e.select(
        "job_id",
        "node_id",
        "seq",
        F.when(F.col("seq") % 17 == 0, F.lit("bad"))
        .otherwise(F.col("timestamp").cast("decimal(20,6)").cast("string"))
        .alias("timestamp"),
        F.when(F.col("seq") % 5 == 0, F.lit("N/A"))
        .otherwise(F.col("utilization_gpu_pct").cast("int").cast("string"))
        .alias("utilization_gpu_pct"),
        F.when(F.col("seq") % 7 == 0, F.lit(""))
        .otherwise(F.col("utilization_memory_pct").cast("int").cast("string"))
        .alias("utilization_memory_pct"),
        F.when(F.col("seq") % 11 == 0, F.lit("nan"))
        .otherwise(F.col("memory_used_MiB").cast("decimal(20,4)").cast("string"))
        .alias("memory_used_MiB"),
        F.when(F.col("seq") % 13 == 0, F.lit("1.5d"))
        .otherwise(F.col("power_draw_W").cast("decimal(20,4)").cast("string"))
        .alias("power_draw_W"),
    )


def scheduler_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounting records from ``orders`` under their raw column names."""
    o = table(spark, sf_dir, "orders")
    priority = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("id_job"),
        (F.col("o_custkey") % 128 + 1).alias("cpus_req"),
        F.when(priority == "1-URGENT", F.lit(2e9))
        .otherwise(F.round(F.col("o_totalprice")))
        .alias("mem_req"),
        (F.col("o_totalprice") / F.lit(20.0)).alias("priority"),
        F.when(status == "F", 3).when(status == "O", 5).when(status == "P", 1).alias("state"),
        F.when(priority == "1-URGENT", "LLSUB:BATCH")
        .when(priority == "2-HIGH", "LLSUB:INTERACTIVE")
        .when(priority == "3-MEDIUM", "LLMAPREDUCE:MAP")
        .when(priority == "4-NOT SPECIFIED", "OTHER")
        .when(priority == "5-LOW", "UNKNOWN")
        .alias("job_type"),
        (
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
        ).alias("time_start"),
    )


def large_index_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace index from ``lineitem``, before the duration bounds."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_distinct("l_suppkey").cast("int").alias("nodes_used"),
        (F.sum("l_quantity") * 100).cast("long").alias("length"),
    )
    job = F.col("l_orderkey").cast("string")
    return li.select(
        job.alias("job_id"),
        "nodes_used",
        F.concat(F.lit("traces/"), job).alias("file_path"),
        "length",
        F.round((F.col("length") - 1) * F.lit(0.103), 3).alias("duration_sec"),
        F.lit(0.103).alias("delta_t"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key listing with sizes from ``pages``; every third page is already present."""
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("key"),
        F.length("html").cast("long").alias("bytes"),
        (F.col("page_id") % 3 == 0).alias("present"),
    )
