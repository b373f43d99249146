"""Histogram and correlation tables over the numeric columns of a job table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in _NUMERIC]


def _unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns
    ]
    return df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").filter("v is not null")


def histograms(df: DataFrame, bins: int = 100) -> DataFrame:
    """Equal-width histogram of every numeric column, empty bins included.

    The last bin is closed. A constant column spans half a unit to either side.
    """
    columns = numeric_columns(df)
    cells = _unpivot(df, columns)
    ranges = cells.groupBy("column_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    constant = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        "column_name",
        F.when(constant, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(constant, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    # One row per column of the table.
    small = F.broadcast(ranges)
    position = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins)))
    counted = (
        cells.join(small, "column_name")
        .groupBy("column_name", F.least(position, F.lit(bins - 1).cast("long")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    frame = ranges.select(
        "column_name",
        "lo",
        width.alias("width"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"),
    )
    return frame.join(counted, ["column_name", "bin"], "left").select(
        "column_name",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left_edge"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def correlations(df: DataFrame) -> DataFrame:
    """Pearson correlation of every column pair, lower triangle with diagonal.

    Each pair uses the rows where both are present; a constant column gives NULL.
    A first pass finds the means; the second adds up centered products, one matrix
    product per Arrow batch, so a row costs no row per pair.
    """
    columns = numeric_columns(df)
    facts = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.min(c).alias(f"min_{c}") for c in columns],
        *[F.max(c).alias(f"max_{c}") for c in columns],
    ).first()

    def center(c):
        # A constant column is shifted by its value, so its variance is exactly 0.
        lo, hi = facts[f"min_{c}"], facts[f"max_{c}"]
        return float(0.0 if lo is None else lo if lo == hi else facts[f"mean_{c}"])

    shift = np.array([center(c) for c in columns])
    names = np.array(columns)
    left, right = np.tril_indices(len(columns))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64)
            present = ~np.isnan(x)
            m = present.astype(np.float64)
            x = np.where(present, x - shift, 0.0)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            flat = total[:, left, right]
            yield pd.DataFrame(
                {"col_a": names[left], "col_b": names[right]}
                | {c: flat[i] for i, c in enumerate(("n", "sa", "sb", "saa", "sbb", "sab"))}
            )

    schema = "col_a string, col_b string, n double, sa double, sb double, saa double, sbb double, sab double"
    sums = (
        df.select(*[F.col(c).cast("double").alias(c) for c in columns])
        .mapInPandas(products, schema)
        .groupBy("col_a", "col_b")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    )
    n = F.col("n")
    var_a = F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), n)
    var_b = F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), n)
    cov = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), n)
    # Rounding can leave a column that is constant on a pair's rows just above 0.
    floor = F.lit(1e-24) * F.greatest(n, F.lit(1.0))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / (F.sqrt(var_a) * F.sqrt(var_b))))
    defined = (var_a > floor) & (var_b > floor)
    return sums.select("col_a", "col_b", F.when(defined, r).alias("r"))
