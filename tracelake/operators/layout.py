"""How many parts a table is laid out in, and where they are cut: from its rows, not from a constant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.expressions import double_array

#: Rows that one task sorts, numbers or expands to, about.
TASK_ROWS = 1_000_000
#: Accuracy of the sketches: ranks are right to about ``2 / SKETCH`` of the rows.
SKETCH = 2_048


def parts_of(rows: int, per_part: int = TASK_ROWS) -> int:
    return max(1, -(-rows // per_part))


def tasks_of(spark: SparkSession, rows: int, per_task: int = TASK_ROWS) -> int:
    """Tasks for so many rows; small tables get as many as there are cores for."""
    return max(parts_of(rows, per_task), min(spark.sparkContext.defaultParallelism, parts_of(rows, 10_000)))


def sketches(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Row count and quantile sketch (KLL) of a double column, per group.

    A sketch has a fixed size. Partial ones merge, so every task sends one per group.
    """
    return df.groupBy(*by).agg(
        F.count(value).alias("rows"), F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("sketch")
    )


def cuts(sketched: DataFrame, per_part: int, by: str, most: int = SKETCH // 2) -> dict[str, list[float]]:
    """Per group the bounds that cut its rows into parts of about ``per_part`` rows.

    As many bounds as the sketch can tell apart at most: parts grow beyond that.
    """
    sized = sketched.filter("rows > 0").select(by, "rows", "sketch")
    counts = {r[by]: min(parts_of(r["rows"], per_part), most) for r in sized.select(by, "rows").collect()}
    bounds = F.lit(None).cast("array<double>")
    for group, n in counts.items():
        if n > 1:
            found = F.kll_sketch_get_quantile_double("sketch", double_array([k / n for k in range(1, n)]))
            bounds = F.when(F.col(by) == group, found).otherwise(bounds)
    return {r[by]: sorted(set(r["bounds"] or ())) for r in sized.select(by, bounds.alias("bounds")).collect()}
