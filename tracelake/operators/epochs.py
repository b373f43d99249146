"""Per-epoch order of the windows: which worker sees which window at which step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.expressions import int_div, seeded_hash
from tracelake.operators.rowid import with_row_id


def placed_plan(
    chunks: DataFrame,
    epoch: int,
    world: int,
    batch: int,
    seed: int = 42,
    max_steps: int | None = None,
) -> DataFrame:
    """``(rank, step, pos, job_id, chunk_idx, i)`` for one epoch.

    Windows are shuffled by a hash of seed, epoch and key, dealt out to the workers in
    turn, and cut into batches. The remainder of the deal and the last partial batch
    are dropped, as is every step from ``max_steps`` on. ``pos`` is the place in the batch.
    """
    order = seeded_hash(f"{seed}|{epoch}", F.col("job_id"), F.col("chunk_idx"))
    numbered = with_row_id(chunks.select("job_id", "chunk_idx"), order, ("job_id", "chunk_idx"))
    per_rank = int_div(F.col("n_rows"), F.lit(world))
    full_steps = int_div(per_rank, F.lit(batch))
    if max_steps is not None:
        full_steps = F.least(full_steps, F.lit(max_steps).cast("long"))
    turn = int_div(F.col("row_id"), F.lit(world))
    return (
        numbered.filter(F.col("row_id") < per_rank * world)
        .withColumn("step", int_div(turn, F.lit(batch)))
        .filter(F.col("step") < full_steps)
        .select((F.col("row_id") % world).alias("rank"), "step", (turn % batch).alias("pos"),
                "job_id", "chunk_idx", F.col("row_id").alias("i"))
    )


def epoch_plan(
    chunks: DataFrame,
    epoch: int,
    world: int,
    batch: int,
    seed: int = 42,
    max_steps: int | None = None,
) -> DataFrame:
    """``(rank, step, job_id, chunk_idx, i)``: the epoch's plan without the places in batches."""
    return placed_plan(chunks, epoch, world, batch, seed, max_steps).drop("pos")


def batch_layout(plan: DataFrame) -> DataFrame:
    """Windows per worker and step."""
    return plan.groupBy("rank", "step").agg(F.count(F.lit(1)).alias("n_samples"))


def assemble_batches(plan: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows placed for reading: one batch (rank, step) lies together, in epoch order.

    ``pos`` is a window's place within its batch.
    """
    placed = plan.join(windows, ["job_id", "chunk_idx"])
    # Batches lie one after another in i, each worker taking every world-th row.
    order = Window.partitionBy("rank", "step").orderBy("i")
    placed = placed.repartition("rank", "step").withColumn("pos", F.row_number().over(order) - 1)
    return placed.sortWithinPartitions("rank", "step", "pos")


def write_epoch(plan: DataFrame, windows: DataFrame, path: str, file_steps: int = 64) -> None:
    """Write the batches of a ``placed_plan``: files of ``file_steps`` steps of one worker, in order.

    ``path/batches`` has the windows by ``rank`` and ``part``, ``path/index`` a row per batch: which
    file holds it and how many windows it has. The windows are shuffled once, to the file they go to.
    """
    spark = plan.sparkSession
    rows = plan.join(windows, ["job_id", "chunk_idx"]).withColumn("part", int_div(F.col("step"), F.lit(file_steps)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "rank", "part").sortWithinPartitions("rank", "part", "step", "pos")
    rows.write.option("compression", "zstd").partitionBy("rank", "part").parquet(f"{path}/batches")
    stored = spark.read.schema("rank long, part long, step long, pos long").parquet(f"{path}/batches")
    index = stored.select("rank", "step", "part", "pos", "_metadata.file_path").groupBy("rank", "step", "part", "file_path")
    index.agg(F.count(F.lit(1)).alias("n_samples")).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, step, part, file_path, n_samples)`` of a written epoch."""
    return spark.read.parquet(f"{path}/index")


def read_epoch(spark: SparkSession, path: str, rank: int | None = None, first_step: int = 0) -> DataFrame:
    """The windows of a written epoch, of one worker from a step on if asked for.

    A worker's folder and the parts before ``first_step`` are pruned. The rows of a file are in the order
    of steps and places; within a partition they are sorted by them.
    """
    rows = spark.read.parquet(f"{path}/batches")
    if rank is not None:
        rows = rows.filter(F.col("rank") == rank)
    if first_step:
        first = read_index(spark, path).filter(F.col("step") >= first_step).agg(F.min("part")).first()[0]
        rows = rows.filter((F.col("part") >= (first or 0)) & (F.col("step") >= first_step))
    return rows.sortWithinPartitions("rank", "step", "pos")
