"""Exactly the first n rows in the order of a hash, without numbering or sorting the table.

Hash prefixes are counted per group; the prefix in which the n-th row lies is known from the counts,
and only its rows (one in 4,096 as shipped) are ordered to find the n-th. All others are in or out by a
comparison with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 3


def mark_first(
    df: DataFrame,
    hashed: Column,
    tie: tuple[str, ...],
    wanted: Callable[[Column], Column],
    by: tuple[str, ...] = (),
    name: str = "selected",
    digits: int = HEX_DIGITS,
) -> DataFrame:
    """Add ``name``: whether a row is among the first ``wanted(rows of its group)`` in (hash, tie) order.

    ``hashed`` is a hex text, ``tie`` makes rows of a group unique. Reads ``df`` three times.
    """
    place = F.struct(F.col("_h"), *[F.col(t) for t in tie])
    rows = df.withColumn("_h", hashed).withColumn("_b", F.substring("_h", 1, digits))
    counts = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by).orderBy("_b")
    before = F.coalesce(F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sized = counts.select(*by, "_b", "_n", before.alias("_before"), total.alias("_total"))
    need = (wanted(F.col("_total")).cast("long") - F.col("_before")).alias("_need")
    cut = sized.select(*by, "_b", "_n", need).filter("_need > 0 AND _need <= _n").drop("_n")
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *tie)
    ordered = rows.join(cut, [*by, "_b"]).withColumn("_place", F.row_number().over(inside))
    last = ordered.filter(F.col("_place") == F.col("_need")).select(*by, place.alias("_last"))
    if by:
        marked = rows.join(last, list(by), "left").withColumn("_in", place <= F.col("_last"))
    else:
        found = last.first()
        bound = F.lit(None) if found is None else F.struct(*[F.lit(v) for v in found["_last"]])
        marked = rows.withColumn("_in", (place <= bound) if found is not None else F.lit(False))
    return marked.withColumn(name, F.coalesce("_in", F.lit(False))).drop("_h", "_b", "_in", "_last")
