"""Exact row numbers over a whole table without a single-task sort.

Rows are cut into buckets by the leading hex digits of a seeded hash. Each bucket is
numbered on its own and shifted by the size of the buckets before it. The bucket
table has at most 16**digits rows per group, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.expressions import count_below
from tracelake.operators import layout

HEX_DIGITS = 3
#: Rows of a range bucket, which one task numbers.
BUCKET_ROWS = 100_000


def with_row_id(
    df: DataFrame,
    hashed: Column,
    tie: tuple[str, ...],
    by: tuple[str, ...] = (),
    name: str = "row_id",
    total: str = "n_rows",
    digits: int = HEX_DIGITS,
) -> DataFrame:
    """Add a 0-based row number in (hash, tie) order and the row count, per ``by`` group.

    A group holding a third of all rows is still numbered by 16**digits tasks' worth
    of buckets, because the hash spreads it.
    """
    rows = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, digits))
    return _number(rows, "_b", [F.col("_h"), *[F.col(t) for t in tie]], by, name, total).drop("_h")


def _number(rows, bucket, order, by, name, total):
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*by).orderBy(bucket)
    offsets = counts.select(
        *by,
        bucket,
        F.coalesce(
            F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_offset"),
        F.sum("_n")
        .over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        .alias(total),
    )
    if not by:
        offsets = F.broadcast(offsets)
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    keep = [c for c in rows.columns if c != bucket]
    return (
        rows.join(offsets, [*by, bucket])
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .select(*keep, name, total)
    )


def with_ordered_row_id(
    df: DataFrame, key: str, name: str = "row_id", total: str = "n_rows", buckets: int | None = None
) -> DataFrame:
    """Row numbers in the natural order of a unique key.

    The rows tell the number of range buckets. Their bounds come from a reproducible sample, ``16``
    keys a bucket, those with the smallest hash. Any bounds give exact numbers; they only balance.
    """
    buckets = layout.parts_of(df.count(), BUCKET_ROWS) if buckets is None else buckets
    sample = [
        r[0]
        for r in df.select(key)
        .orderBy(F.md5(F.col(key).cast("string")), key)
        .limit(16 * buckets)
        .collect()
    ]
    sample.sort()
    bounds = [sample[len(sample) * i // buckets] for i in range(1, buckets)] if sample else []
    bucket = count_below(F.lit(bounds), len(bounds), F.col(key)) if bounds else F.lit(0)
    rows = df.withColumn("_b", bucket)
    return _number(rows, "_b", [F.col(key)], (), name, total)
