"""Forward fill and densify on an integer grid, in blocks.

A series is cut into blocks of ``block`` grid positions and every step runs per
(series, block), so one long or heavy series is spread over many tasks. Only one
summary row per occupied block crosses between blocks: from the summaries we derive

* a *seed* row at the start of each block the series continues into, holding the
  values carried over from earlier blocks, and
* a *stop* row just past the end of each block the series runs through.

With those rows present, fill and gap expansion need nothing from outside the block,
and no gap expands to more than ``block`` rows at once.

Series of two levels are filled: nodes, and the jobs made of them. The summaries of the
job level follow from those of the node level (:func:`job_spans`), so the dense rows are
produced once and never summarized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEED, _REAL, _STOP = 0, 1, 2


def with_block(df: DataFrame, block: int) -> DataFrame:
    """Add the block number of grid position ``k`` (floor division, negatives included)."""
    return df.withColumn("blk", F.floor(F.col("k") / F.lit(block)))


def spread(df: DataFrame, *cols: str, parts: int | None = None) -> DataFrame:
    """Hash-distribute by ``cols`` over ``parts`` partitions.

    The count is explicit because the rows multiply right after this shuffle: sizing
    the partitions by the shuffled bytes, as adaptive coalescing does, would leave
    too few tasks for the expanded grid. Callers that know the rows after the expansion derive
    it from them (``layout.tasks_of``); without it the configured number of partitions holds.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def summarize(binned: DataFrame, series: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Per (series, block): last position, and first and last known value per metric."""

    def known(m):
        return F.when(F.col(m).isNotNull(), F.col("k"))

    return binned.groupBy(*series, "blk").agg(
        F.max("k").alias("max_k"),
        *[F.max_by(m, known(m)).alias(f"last_{m}") for m in metrics],
        *[F.min_by(m, known(m)).alias(f"first_{m}") for m in metrics],
        *[F.min(known(m)).alias(f"at_{m}") for m in metrics],
    )


def node_spans(
    summary: DataFrame, series: tuple[str, ...], metrics: tuple[str, ...], block: int
) -> DataFrame:
    """Per occupied block ``cur`` of a series: the occupied block before it, the values
    carried in, the values at its end, and the last position it covers."""
    order = Window.partitionBy(*series).orderBy("blk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.lead("blk").over(order).isNotNull()
    spans = summary.select(
        *series,
        F.lag("blk").over(order).alias("prev"),
        F.col("blk").alias("cur"),
        F.when(goes_on, (F.col("blk") + 1) * block - 1).otherwise(F.col("max_k")).alias("end_k"),
        *[F.last(f"last_{m}", ignorenulls=True).over(before).alias(m) for m in metrics],
        *[F.last(f"last_{m}", ignorenulls=True).over(here).alias(f"end_{m}") for m in metrics],
        *[f"{part}_{m}" for part in ("last", "first", "at") for m in metrics],
    )
    # Always true, as end_k is never NULL. Reading every column keeps the summaries'
    # shuffle alike for all uses of the spans, so that Spark runs it once.
    payload = [F.col(c) for c in spans.columns if c not in (*series, "cur")]
    return spans.filter(F.coalesce(*payload).isNotNull())


def _combined(c: Column, how: str) -> Column:
    return F.avg(c) if how == "mean" else F.coalesce(F.sum(c), F.lit(0.0))


def job_spans(
    spans: DataFrame, series: tuple[str, ...], job: str, how: dict[str, str], block: int
) -> DataFrame:
    """What :func:`node_spans` says about nodes, for the job they combine to.

    At the last position a job covers in a block, the nodes present are just those
    ending there; the same holds for the last position with a known value, because a
    node's value stays known once it is. So a job's value there combines the end values
    of the nodes with the greatest end. The first known value mirrors this. Values
    carried in start from the first known one, and from 0.0 if there is none.
    """
    later = F.greatest(F.coalesce(F.col("prev") + 1, F.col("cur")), F.lit(0).cast("long"))
    ends = (
        spans.filter(F.col("cur") >= 0)
        .select("*", F.explode(F.sequence(later, F.col("cur"))).alias("blk"))
        .select(
            job,
            "blk",
            F.when(F.col("blk") < F.col("cur"), (F.col("blk") + 1) * block - 1)
            .otherwise(F.col("end_k"))
            .alias("end_k"),
            *[
                F.when(F.col("blk") < F.col("cur"), F.col(m)).otherwise(F.col(f"end_{m}")).alias(m)
                for m in how
            ],
        )
        .groupBy(job, "blk", "end_k")
        .agg(*[_combined(F.col(m), h).alias(m) for m, h in how.items()])
        .groupBy(job, "blk")
        .agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col("end_k"))).alias(m) for m in how])
    )
    order = Window.partitionBy(job).orderBy("blk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        ends.join(_first_known(spans, series, job, how), job)
        .select(
            job,
            F.coalesce(F.lag("blk").over(order), F.lit(-1).cast("long")).alias("prev"),
            F.col("blk").alias("cur"),
            *[
                F.coalesce(
                    F.last(m, ignorenulls=True).over(before), F.col(f"first_{m}"), F.lit(0.0)
                ).alias(m)
                for m in how
            ],
        )
    )


def _first_known(
    spans: DataFrame, series: tuple[str, ...], job: str, how: dict[str, str]
) -> DataFrame:
    """Per job and metric the first known value at or after position 0."""
    grid = F.col("cur") >= 0

    def where_known(c, side):
        return F.when(side & F.col(c).isNotNull(), F.col("cur"))

    nodes = spans.groupBy(*series).agg(
        F.max("cur").alias("top"),
        *[F.max_by(f"last_{m}", where_known(f"last_{m}", ~grid)).alias(f"carry_{m}") for m in how],
        *[F.min_by(f"first_{m}", where_known(f"first_{m}", grid)).alias(f"value_{m}") for m in how],
        *[F.min(F.when(grid, F.col(f"at_{m}"))).alias(f"at_{m}") for m in how],
    ).filter(F.col("top") >= 0)
    cells = []
    for i, m in enumerate(how):
        carried = F.col(f"carry_{m}").isNotNull()
        own = F.coalesce(F.col(f"at_{m}") == 0, F.lit(False)) | ~carried
        cells.append(
            F.struct(
                F.lit(i).alias("metric"),
                F.when(carried, F.lit(0).cast("long")).otherwise(F.col(f"at_{m}")).alias("at"),
                F.when(own, F.col(f"value_{m}")).otherwise(F.col(f"carry_{m}")).alias("v"),
            )
        )
    return (
        nodes.select(job, F.explode(F.array(*cells)).alias("c"))
        .select(job, "c.*")
        .filter(F.col("v").isNotNull())
        .groupBy(job, "metric", "at")
        .agg(F.avg("v").alias("mean"), F.sum("v").alias("sum"))
        .groupBy(job)
        .agg(
            *[
                F.min_by(h, F.when(F.col("metric") == i, F.col("at"))).alias(f"first_{m}")
                for i, (m, h) in enumerate(how.items())
            ]
        )
    )


def fences(
    spans: DataFrame, series: tuple[str, ...], partition: tuple[str, ...],
    metrics: tuple[str, ...], block: int, parts: int | None = None,
) -> DataFrame:
    """Seed and stop rows for every block between ``prev`` and ``cur``, distributed like the bins."""
    step = F.lit(block)
    kinds = F.array(
        F.when(
            F.col("blk") > F.col("prev"),
            F.struct((F.col("blk") * step).alias("k"), F.lit(_SEED).alias("kind")),
        ),
        F.when(
            (F.col("blk") < F.col("cur")) & (F.col("blk") >= 0),
            F.struct(((F.col("blk") + 1) * step).alias("k"), F.lit(_STOP).alias("kind")),
        ),
    )
    # Positions below 0 are never emitted, so blocks below -1 need no fences.
    rows = (
        spans.filter((F.col("cur") >= 0) & F.col("prev").isNotNull())
        .withColumn("prev", F.greatest(F.col("prev"), F.lit(-1).cast("long")))
        .select("*", F.explode(F.sequence("prev", "cur")).alias("blk"))
        .select("*", F.explode(kinds).alias("f"))
        .filter(F.col("f").isNotNull())
        .select(
            *series,
            "blk",
            F.col("f.k").alias("k"),
            *[F.when(F.col("f.kind") == _SEED, F.col(m)).alias(m) for m in metrics],
            F.col("f.kind").alias("kind"),
        )
    )
    return spread(rows, *partition, parts=parts)


def fill(
    binned: DataFrame, fence_rows: DataFrame, series: tuple[str, ...], metrics: tuple[str, ...]
) -> DataFrame:
    """Dense rows ``(series, blk, k, metrics)`` for ``k >= 0``, values carried forward.

    ``binned`` has one row per (series, k) and is distributed like the fences; the
    result keeps that distribution.
    """
    rows = binned.select(
        *series, "blk", "k", *metrics, F.lit(_REAL).alias("kind")
    ).unionByName(fence_rows)
    inside = Window.partitionBy(*series, "blk").orderBy("k", "kind")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.select(
        *series,
        "blk",
        "kind",
        F.greatest(F.col("k"), F.lit(0).cast("long")).alias("lo"),
        F.coalesce(F.lead("k").over(inside) - 1, F.col("k")).alias("hi"),
        *[F.last(m, ignorenulls=True).over(so_far).alias(m) for m in metrics],
    )
    return filled.filter((F.col("kind") != _STOP) & (F.col("hi") >= F.col("lo"))).select(
        *series, "blk", F.explode(F.sequence("lo", "hi")).alias("k"), *metrics
    )
