"""Node and job gates: sampling interval, common origin, node coverage, trace facts.

Everything here is one row per node or per job, so it is cheap next to the samples
and decides which samples the resampling has to touch at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.config import SOURCE_METRICS, ResampleConfig
from tracelake.functions.expressions import parse_number

NODE = ("job_id", "node_id")


def parse_metrics(raw: DataFrame) -> DataFrame:
    """Text telemetry to doubles. Rows without a usable timestamp keep a NULL there:
    the probe counts raw rows, so dropping them is left to the consumers."""
    cols = ("timestamp", *SOURCE_METRICS)
    return raw.select(
        *[c for c in raw.columns if c not in cols],
        *[parse_number(F.col(c)).alias(c) for c in cols],
    )


def probe_nodes(telemetry: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """First-row timestamp and sampling interval of every node.

    ``row_number() <= n`` is planned as a group limit on both sides of the shuffle, so
    a node with billions of samples sends at most ``probe_rows`` rows per input task.
    """
    order = Window.partitionBy(*NODE).orderBy("seq")
    # The key filter states what the joins on it imply, so that every use of this
    # plan looks the same and Spark runs its shuffle once.
    first = (
        telemetry.filter(F.col("job_id").isNotNull() & F.col("node_id").isNotNull())
        .select(*NODE, "seq", "timestamp")
        .withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= cfg.probe_rows)
    )
    # The set holds at most probe_rows values.
    stats = first.groupBy(*NODE).agg(
        F.max(F.when(F.col("rn") == 1, F.col("timestamp"))).alias("first_ts"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
        F.size(F.collect_set("timestamp")).alias("n_distinct"),
    )
    interval = F.when(
        F.col("n_distinct") >= 2, (F.col("hi") - F.col("lo")) / (F.col("n_distinct") - 1)
    )
    return stats.select(*NODE, "first_ts", interval.alias("interval"))


def node_facts(
    telemetry: DataFrame, cfg: ResampleConfig, nodes: DataFrame | None = None
) -> DataFrame:
    """One row per node: first timestamp, interval and the rate gate.

    A node passing the gate has at least two distinct valid timestamps, so the
    "fewer than two rows" rejection is implied. ``nodes`` (job_id, node_id) lists
    nodes known to exist even when their file holds no row; they count as unusable.
    """
    facts = probe_nodes(telemetry, cfg)
    if nodes is not None:
        facts = nodes.select(*NODE).dropDuplicates().join(facts, list(NODE), "left")
    usable = F.coalesce(F.col("interval").between(cfg.dt_min, cfg.dt_max), F.lit(False))
    return facts.withColumn("usable", usable)


def readable_nodes(facts: DataFrame, status: DataFrame) -> DataFrame:
    """The node facts after the files were read: a node with a file that is not ``ok`` is unusable. Adds ``n_rows``.

    ``status`` has the state and the number of samples of every file that was read to its end; nodes
    without a row there were not read and stay as they are.
    """
    whole = (F.count_if(F.col("status") != "ok") == 0).alias("_whole")
    read = status.groupBy(*NODE).agg(whole, F.sum("n_rows").alias("n_rows"))
    usable = F.col("usable") & F.coalesce("_whole", F.lit(True))
    return facts.join(read, list(NODE), "left").withColumn("usable", usable).drop("_whole")


def job_gate(facts: DataFrame, cfg: ResampleConfig) -> DataFrame:
    """One row per job: counts, common origin ``t0`` and the rejection reason or NULL.

    Rejected nodes still count towards ``t0``; a node whose first value is missing
    contributes nothing to it.
    """
    jobs = facts.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("nodes_total"),
        F.count_if(F.col("usable")).alias("nodes_used"),
        F.min("first_ts").alias("t0"),
    )
    low = F.col("nodes_used") / F.col("nodes_total") < cfg.min_node_keep_ratio
    ratio = F.concat_ws(
        "/", F.col("nodes_used").cast("string"), F.col("nodes_total").cast("string")
    )
    reason = (
        F.when(F.col("t0").isNull(), F.lit("no_readable_t0"))
        .when(low, F.concat(F.lit("low_node_ratio:"), ratio))
        .when(F.col("nodes_used") == 0, F.lit("no_usable_nodes"))
    )
    return jobs.withColumn("reason", reason)


def kept_nodes(facts: DataFrame, gate: DataFrame) -> DataFrame:
    """Usable nodes of the jobs that passed, with their job's origin."""
    good = gate.filter(F.col("reason").isNull()).select("job_id", "t0")
    known = [c for c in ("n_rows",) if c in facts.columns]
    return facts.filter("usable").select(*NODE, *known).join(good, "job_id")


def bin_index(cfg: ResampleConfig):
    """Grid position of a sample relative to ``t0``; may be negative."""
    return F.floor((F.col("timestamp") - F.col("t0")) / F.lit(cfg.dt) + F.lit(1e-12))


def trace_facts(
    telemetry: DataFrame,
    cfg: ResampleConfig,
    facts: DataFrame | None = None,
    gate: DataFrame | None = None,
) -> DataFrame:
    """Per-job outcome and trace facts without building the trace.

    The last grid position of a job is the position of its last sample on a kept
    node, so length and duration follow from one hash aggregate over timestamps.
    """
    facts = node_facts(telemetry, cfg) if facts is None else facts
    gate = job_gate(facts, cfg) if gate is None else gate
    last = (
        telemetry.groupBy(*NODE)
        .agg(F.max("timestamp").alias("timestamp"))
        .join(facts.filter("usable").select(*NODE), list(NODE), "left_semi")
        .groupBy("job_id")
        .agg(F.max("timestamp").alias("timestamp"))
    )
    jobs = gate.join(last, "job_id", "left").withColumn("k_max", bin_index(cfg))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.col("k_max") < 0, F.lit("neg_kmax")
    )
    return jobs.select(
        "job_id", "nodes_total", "nodes_used", "t0", "k_max", reason.alias("reason")
    )


def grid_rows(index: DataFrame) -> int:
    """Bins of the indexed jobs' nodes: the rows that resampling expands to, at most."""
    return index.agg(F.coalesce(F.sum(F.col("length") * F.col("nodes_used")), F.lit(0))).first()[0]


def finished_facts(gate: DataFrame, traces: DataFrame) -> DataFrame:
    """The same facts from a written trace table, read for two columns only."""
    last = traces.groupBy("job_id").agg(F.max("k").alias("k_max"))
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        F.col("k_max").isNull(), F.lit("neg_kmax")
    )
    return gate.join(last, "job_id", "left").select(
        "job_id", "nodes_total", "nodes_used", "t0", "k_max", reason.alias("reason")
    )


def trace_index(facts: DataFrame, cfg: ResampleConfig, root: str = "traces") -> DataFrame:
    """Index of finished traces inside the duration bounds (both ends included).

    ``facts`` is the output of :func:`trace_facts`. Every trace lives in one table, so
    ``file_path`` names the table's folder and the job inside it.
    """
    return (
        facts.filter(F.col("reason").isNull() & F.col("k_max").isNotNull())
        .select(
            "job_id",
            F.col("nodes_used").cast("int").alias("nodes_used"),
            F.concat(F.lit(root.rstrip("/") + "/"), F.col("job_id")).alias("file_path"),
            (F.col("k_max") + 1).alias("length"),
            F.round(F.col("k_max") * F.lit(cfg.dt), 3).alias("duration_sec"),
            F.lit(cfg.dt).alias("delta_t"),
        )
        .filter(F.col("duration_sec").between(cfg.lower_sec, cfg.upper_sec))
    )


def job_outcomes(facts: DataFrame) -> DataFrame:
    """One status per job: ``ok`` or ``failed`` with the reason as detail."""
    return facts.select(
        "job_id",
        F.when(F.col("reason").isNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.coalesce("reason", F.lit("")).alias("detail"),
    )


def exit_status(outcomes: DataFrame) -> int:
    """1 if any job failed, else 0. Stops at the first failed row."""
    return 0 if outcomes.filter(F.col("status") != "ok").isEmpty() else 1
