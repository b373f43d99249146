"""Helpers shared by the operators: input columns, written tables, Arrow slabs of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.storage import materialize as written  # noqa: F401

#: Bytes of text that a vectorized kernel holds at once (one longer text is held whole).
SLAB_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(df: DataFrame, rows: int, *key: str, of: int | None = None) -> DataFrame:
    """The first ``rows`` rows in hash order of a unique key, or all if there are no more.

    A cut at a hash value leaves little more than the sample before rows are ordered, so that
    what tasks send does not grow with their number. ``of`` is the size of ``df`` if known.
    """
    hashed, total = F.xxhash64(*key), df.count() if of is None else of
    share = min(1.0, (1.2 * rows + 1000) / max(total, 1))
    near = df.filter(F.pmod(hashed, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return near.orderBy(F.pmod(hashed, F.lit(1 << 30)), hashed, *key).limit(rows)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, so others may have any name."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def slabs(
    batch: pa.RecordBatch, column: str = "text", limit: int = SLAB_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as ``(first, end, bytes, offsets)``; null counts as empty.

    A run holds at most ``limit`` bytes, or one row that is longer by itself.
    """
    data = batch.column(column).cast(pa.large_binary())
    if data.null_count:
        data = data.fill_null(b"")
    if not len(data):
        return
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    buffer = data.buffers()[2]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(data):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(data))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
