"""Declared schemas of the tables that cross a file boundary, and the column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.config import CHANNEL_NAMES, FEATURES, SOURCE_METRICS

TELEMETRY_CSV = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("timestamp", *SOURCE_METRICS)]
)

SCHEDULER_CSV_TYPES = {
    "id_job": T.LongType(),
    "cpus_req": T.LongType(),
    "mem_req": T.DoubleType(),
    "priority": T.DoubleType(),
    "state": T.IntegerType(),
    "job_type": T.StringType(),
    "time_start": T.LongType(),
}

TRACES = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("k", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        *[T.StructField(c, T.FloatType()) for c in CHANNEL_NAMES],
    ]
)

TRACE_INDEX = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("nodes_used", T.IntegerType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("duration_sec", T.DoubleType()),
        T.StructField("delta_t", T.DoubleType()),
    ]
)

REQUIRED_JOB_COLUMNS = ("job_id", "file_path", "length", "duration_sec", *FEATURES)


def require_columns(df: DataFrame, required=REQUIRED_JOB_COLUMNS) -> DataFrame:
    """Return ``df`` unchanged, or fail naming every missing column. Reads no data."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def column_report(df: DataFrame, required=REQUIRED_JOB_COLUMNS) -> DataFrame:
    """``(column_name, present, n_values)`` for every required column, in one pass."""
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(int(c in df.columns)).alias("present"),
            (F.count(c) if c in df.columns else F.count(F.lit(None))).alias("n_values"),
        )
        for c in required
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
