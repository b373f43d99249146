"""Scheduler CSV, and the stored tables between the stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.schemas import SCHEDULER_CSV_TYPES, TRACES


def scan_scheduler(spark: SparkSession, path: str) -> DataFrame:
    """Accounting records: the used columns, picked by header name.

    All columns of the file are declared as text from its header line, so parsing is
    pruned to the used ones and no pass infers types.
    """
    header = spark.read.option("header", True).csv(path).columns
    raw = (
        spark.read.option("header", True)
        .schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
        .csv(path)
    )
    missing = [c for c in SCHEDULER_CSV_TYPES if c not in header]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return raw.select(*[_typed(F.col(c), t).alias(c) for c, t in SCHEDULER_CSV_TYPES.items()])


def _typed(c: Column, kind: T.DataType) -> Column:
    """Text to the declared type; a whole number may be written as ``5.0``."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.DoubleType):
        return c.try_cast(kind)
    return F.coalesce(c.try_cast(kind), c.try_cast("double").try_cast(kind))


def write_traces(traces: DataFrame, path: str) -> None:
    """zstd Parquet, bins in order within each file.

    Resampled rows already lie by (job, block), so no shuffle happens here and a long
    job spreads over several files.
    """
    (
        traces.sortWithinPartitions("job_id", "k")
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACES).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Any stage table as zstd Parquet; splits go to one folder per ``split`` value."""
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system it names."""
    files, place = _hadoop(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what a write that died has left."""
    files, place = _hadoop(spark, path)
    files.delete(place, True)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The whole path of a local or mounted folder, also if it has no scheme; None in other stores."""
    files, place = _hadoop(spark, path)
    found = files.makeQualified(place).toUri()
    return f"file:{found.getPath()}" if found.getScheme() == "file" else None


def mark(spark: SparkSession, path: str) -> None:
    """An empty file: the sign of a write that has ended."""
    files, place = _hadoop(spark, path)
    files.create(place, True).close()


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """Number, folder and completion of the written versions, oldest first."""
    files, place = _hadoop(spark, path)
    if not files.exists(place):
        return []
    found = []
    for status in files.listStatus(place):
        folder = status.getPath()
        if folder.getName().startswith("version="):
            done = exists(spark, f"{folder.toString()}/_SUCCESS")
            found.append((int(folder.getName()[8:]), folder.toString(), done))
    return sorted(found)


def write_version(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A stage table that a later call replaces.

    Every call writes a folder of its own, which counts once Spark has marked it complete, so
    readers never see half a table. The version before stays for those who read it; older ones
    and those left by calls that died are removed.
    """
    spark, before = df.sparkSession, _versions(df.sparkSession, path)
    number = before[-1][0] + 1 if before else 0
    write_table(df, f"{path}/version={number:09d}", partition_by)
    complete = [folder for _, folder, done in before if done]
    for _, folder, _ in before:
        if folder not in complete[-1:]:
            files, place = _hadoop(spark, folder)
            files.delete(place, True)


def version_path(spark: SparkSession, path: str) -> str:
    """Folder of the last complete version."""
    complete = [folder for _, folder, done in _versions(spark, path) if done]
    if not complete:
        raise FileNotFoundError(f"no complete version of {path}")
    return complete[-1]


def read_version(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(version_path(spark, path))


def write_export(export: DataFrame, path: str, file_bins: int = 1 << 20) -> None:
    """Aligned real and generated traces as CSV, one folder per job.

    A job's folder gets one file per ``file_bins`` bins, so no task writes a whole long job.
    """
    part = F.floor(F.col("k") / F.lit(file_bins))
    (
        export.withColumn("_part", part)
        .repartition("job_id", "_part")
        .sortWithinPartitions("job_id", "k")
        .drop("k", "_part")
        .write.partitionBy("job_id")
        .option("header", True)
        .csv(path)
    )
