"""Resume, fetch planning and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.expressions import int_div
from tracelake.operators.evaluate import merge_rows
from tracelake.operators.rowid import with_ordered_row_id


def pending_units(units: DataFrame, manifest: DataFrame, min_bytes: int, key: str = "key") -> DataFrame:
    """Units without a finished output of at least ``min_bytes``."""
    done = manifest.filter(F.col("bytes") >= min_bytes).select(key)
    return units.join(done, key, "left_anti")


def progress_counts(units: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: units done and still to do."""
    todo = pending.agg(F.count(F.lit(1)).alias("n_todo"))
    total = units.agg(F.count(F.lit(1)).alias("n_total"))
    return merge_rows(total, todo).select(
        (F.col("n_total") - F.col("n_todo")).alias("n_done"), "n_todo"
    )


def fetch_plan(listing: DataFrame, have: DataFrame, batch: int, key: str = "key") -> DataFrame:
    """Every listed key with its batch and whether it is to be fetched or skipped.

    Batches follow the order of the listing. ``listing`` has one row per key.
    """
    numbered = with_ordered_row_id(listing.select(key), key)
    marked = numbered.join(
        have.select(key).distinct().withColumn("_have", F.lit(True)), key, "left"
    )
    return marked.select(
        key,
        int_div(F.col("row_id"), F.lit(batch)).alias("batch_no"),
        F.when(F.col("_have").isNotNull(), F.lit("skipped"))
        .otherwise(F.lit("downloaded"))
        .alias("status"),
    )


def fetch_totals(plan: DataFrame) -> DataFrame:
    return plan.groupBy("batch_no", "status").agg(F.count(F.lit(1)).alias("n"))


def phase_rows(counts: DataFrame, phase: str) -> DataFrame:
    """A one-row table of counts as ``(phase, metric, value)`` rows."""
    cells = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value"))
        for c in counts.columns
    ]
    return counts.select(F.lit(phase).alias("phase"), F.explode(F.array(*cells)).alias("e")).select(
        "phase", "e.metric", "e.value"
    )


def phase_report(phases: dict[str, DataFrame]) -> DataFrame:
    """Report over one-row count tables, one per phase."""
    report = None
    for phase, counts in phases.items():
        rows = phase_rows(counts, phase)
        report = rows if report is None else report.unionByName(rows)
    return report
