"""Exact quantiles at integer rank positions, and the quantile-to-normal transform."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.expressions import (
    QUANTILE_EPS,
    count_below,
    double_array,
    int_div,
    normal_quantile,
)
from tracelake.operators import layout
from tracelake.storage import materialize

#: Different values of a bucket, which one task numbers.
BUCKET_VALUES = 100_000


def _value_buckets(bounds: dict[str, list[float]]):
    """Range bucket of (column_name, v) by literal bounds."""
    expr = F.lit(None).cast("int")
    for column, cuts in bounds.items():
        inner = count_below(double_array(cuts), len(cuts), F.col("v")) if cuts else F.lit(0)
        expr = F.when(F.col("column_name") == column, inner).otherwise(expr)
    return expr


def quantile_table(df: DataFrame, targets: dict[str, int], cap: bool = True) -> DataFrame:
    """Rows ``(column_name, i, n, q)``: quantile ``i / (n - 1)`` of every target column.

    ``targets`` maps a column to its number of quantiles; ``cap`` limits that to the
    number of values. Quantile i sits at rank ``i * (N - 1) div (n - 1)`` with the
    exact remainder as interpolation weight.

    Equal values are counted before the shuffle. Distinct values are then numbered
    within range buckets, and each value works out by arithmetic which quantiles fall
    on it, so no rank list is joined and no task sees a whole column. The bucket
    bounds come from mergeable sketches of the columns; they only balance the work.
    """
    long = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v"))
                    for c in targets
                ]
            )
        ).alias("e")
    ).select("e.*")
    # Written once: the bounds and both sides of the ranking read it.
    counts = materialize(
        long.filter(F.col("v").isNotNull())
        .groupBy("column_name", "v")
        .agg(F.count(F.lit(1)).alias("c")),
        "value-counts",
    )
    bounds = layout.cuts(layout.sketches(counts, "v", ("column_name",)), BUCKET_VALUES, "column_name")
    rows = counts.withColumn("b", _value_buckets(bounds))
    ordered = Window.partitionBy("column_name").orderBy("b")
    offsets = (
        rows.groupBy("column_name", "b")
        .agg(F.sum("c").alias("s"), F.min("v").alias("bucket_min"))
        .select(
            "column_name",
            "b",
            F.coalesce(
                F.sum("s").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("offset"),
            F.lead("bucket_min").over(ordered).alias("next_min"),
            F.sum("s")
            .over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            .alias("n_values"),
        )
    )
    inside = Window.partitionBy("column_name", "b").orderBy("v")
    wanted = F.lit(None).cast("long")
    for column, n in targets.items():
        wanted = F.when(F.col("column_name") == column, F.lit(n).cast("long")).otherwise(wanted)
    if cap:
        wanted = F.least(wanted, F.col("n_values"))
    # A row per bucket, of which a sketch gives a fixed number at most.
    ranked = rows.join(F.broadcast(offsets), ["column_name", "b"]).select(
        "column_name",
        "v",
        "n_values",
        wanted.alias("n"),
        (F.col("offset") + F.sum("c").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("end"),
        F.col("c"),
        F.coalesce(F.lead("v").over(inside), F.col("next_min")).alias("above"),
    )
    gaps = F.greatest(F.col("n_values") - 1, F.lit(1))

    def first_at(rank):
        """Smallest quantile number whose position is at or beyond ``rank``."""
        return int_div(rank * (F.col("n") - 1) + gaps - 1, gaps)

    hits = ranked.select(
        "*",
        F.when(F.col("n_values") == 1, F.lit(0).cast("long"))
        .otherwise(first_at(F.col("end") - F.col("c")))
        .alias("i_lo"),
        F.when((F.col("n_values") == 1) | (F.col("end") == F.col("n_values")), F.col("n") - 1)
        .otherwise(first_at(F.col("end")) - 1)
        .alias("i_hi"),
    ).filter((F.col("i_lo") <= F.col("i_hi")) & (F.col("i_lo") < F.col("n")))
    steps = F.greatest(F.col("n") - 1, F.lit(1))
    scaled = F.col("i") * (F.col("n_values") - 1)
    position = int_div(scaled, steps)
    weight = (scaled % steps).cast("double") / steps.cast("double")
    upper = F.when(position + 1 < F.col("end"), F.col("v")).otherwise(
        F.coalesce(F.col("above"), F.col("v"))
    )
    return hits.select("*", F.explode(F.sequence("i_lo", "i_hi")).alias("i")).select(
        "column_name",
        "i",
        "n",
        F.least(F.col("v") + weight * (upper - F.col("v")), upper).alias("q"),
    )


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row ``(column_name, median)`` per column with data."""
    table = quantile_table(df, {c: 3 for c in columns}, cap=False)
    return table.filter("i = 1").select("column_name", F.col("q").alias("median"))


@dataclass(frozen=True)
class QuantileNormal:
    """Fitted transform. Holds at most the requested number of quantiles per column."""

    quantiles: dict[str, list[float]]

    @classmethod
    def fit(cls, df: DataFrame, targets: dict[str, int]) -> "QuantileNormal":
        return cls.from_table(quantile_table(df, targets))

    @classmethod
    def from_table(cls, table: DataFrame) -> "QuantileNormal":
        found: dict[str, dict[int, float]] = {}
        for r in table.collect():
            found.setdefault(r["column_name"], {})[r["i"]] = r["q"]
        return cls({c: [m[i] for i in sorted(m)] for c, m in found.items()})

    def transform(self, df: DataFrame, column: str, output: str) -> DataFrame:
        """Add ``output``: the normal score of ``column``; NULL stays NULL.

        Values inside a run of equal quantiles take the middle of the run; the ends
        map to the clip. With one quantile everything is an end.
        """
        q = self.quantiles.get(column)
        if not q:
            return df.withColumn(output, F.lit(None).cast("double"))
        return df.withColumn(output, _scores(F.col(column).cast("double"), q))


def _scores(x: Column, quantiles: list[float]) -> Column:
    """Normal scores, one Arrow batch at a time: a binary search of many values and the
    inverse normal take a few vector operations, where lambdas would be walked per row."""

    @F.arrow_udf("double")
    def scores(values: pa.Array) -> pa.Array:
        known = np.asarray(values.is_valid())
        v = np.asarray(values.fill_null(0.0), float)
        return pa.array(normal_scores(v, np.array(quantiles)), mask=~known)

    return scores(x)


def normal_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Normal score of each value among ascending quantiles; NaN counts as the largest."""
    below = np.searchsorted(q, v, "left")
    upto = np.searchsorted(q, v, "right")
    width = 1.0 / (len(q) - 1) if len(q) > 1 else 1.0
    left, right = q[np.maximum(below - 1, 0)], q[np.minimum(below, len(q) - 1)]
    with np.errstate(all="ignore"):
        p = (below - 1 + (v - left) / (right - left)) * width
    p = np.where(upto > below, (below + upto - 1) / 2.0 * width, p)
    p = np.where(np.isnan(v) | (v + QUANTILE_EPS > q[-1]), 1.0, p)
    p = np.where(v - QUANTILE_EPS < q[0], 0.0, p)
    return normal_quantile(p)
