"""Counts, means and centred moments that merge.

Sums of squares lose all digits of a small spread beside a large mean. Here every group keeps its count,
mean and squared deviations from its own mean (Spark's aggregates merge those of partial results the
same way), and groups are merged by their deviations from the common mean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: tuple[str, ...], columns: dict[str, Column], pairs=()) -> DataFrame:
    """Per group ``n_``, ``mean_`` and ``m2_`` of every column, and ``c_x_y`` of every pair.

    Rows count for a column, or pair, where its values are known; the columns of a pair must be known
    together.
    """
    aggs = []
    for name, value in columns.items():
        aggs += [
            F.count(value).alias(f"n_{name}"),
            F.coalesce(F.avg(value), F.lit(0.0)).alias(f"mean_{name}"),
            F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias(f"m2_{name}"),
        ]
    for x, y in pairs:
        together = F.covar_pop(columns[x], columns[y]) * F.count(columns[x])
        aggs.append(F.coalesce(together, F.lit(0.0)).alias(f"c_{x}_{y}"))
    return df.groupBy(*keys).agg(*aggs)


@dataclass(frozen=True)
class Moments:
    n: dict[str, int]
    mean: dict[str, float]
    m2: dict[str, float]
    c: dict[tuple[str, str], float]


def merged(groups: DataFrame, columns, pairs=()) -> Moments:
    """The moments of all rows of ``per_group``'s result; pass a written table, it is read twice."""
    weight = lambda x: F.col(f"n_{x}").cast("double")
    sums = groups.agg(
        *[F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(f"n_{x}") for x in columns],
        *[F.coalesce(F.sum(weight(x) * F.col(f"mean_{x}")), F.lit(0.0)).alias(f"s_{x}") for x in columns],
    ).first()
    n = {x: sums[f"n_{x}"] for x in columns}
    mean = {x: sums[f"s_{x}"] / n[x] if n[x] else 0.0 for x in columns}
    off = {x: F.col(f"mean_{x}") - F.lit(mean[x]) for x in columns}
    second = groups.agg(
        *[F.sum(F.col(f"m2_{x}") + weight(x) * off[x] * off[x]).alias(f"m2_{x}") for x in columns],
        *[F.sum(F.col(f"c_{x}_{y}") + weight(x) * off[x] * off[y]).alias(f"c_{x}_{y}") for x, y in pairs],
        # The first mean is rounded; what it is off by is small and well known.
        *[F.sum(weight(x) * off[x]).alias(f"r_{x}") for x in columns],
    ).first()
    rest = {x: (second[f"r_{x}"] or 0.0) / n[x] if n[x] else 0.0 for x in columns}
    return Moments(
        n,
        {x: mean[x] + rest[x] for x in columns},
        {x: max(0.0, (second[f"m2_{x}"] or 0.0) - n[x] * rest[x] ** 2) for x in columns},
        {(x, y): (second[f"c_{x}_{y}"] or 0.0) - n[x] * rest[x] * rest[y] for x, y in pairs},
    )
