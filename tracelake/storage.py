"""Shared-folder handling: lineage cuts and scratch tables that survive executor loss."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The folder of each local session that names none, and the scratch folder of each session.
_LOCAL: dict[str, str] = {}
_SCRATCH: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session whose tasks run in the driver's process may fall back to a temporary
    folder; on a cluster, also one of local processes, a machine-local folder would be out of
    reach or lost together with its executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tracelake-")
    return _LOCAL[app]


def scratch_root(spark: SparkSession) -> str:
    """This session's own folder below the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_root(spark).rstrip('/')}/tracelake/{uuid.uuid4().hex}"
    return _SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this session has materialized; call it when a run has ended.

    Tables of other sessions in the same shared folder stay.
    """
    app = spark.sparkContext.applicationId
    if app in _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop(app))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a table feeds several later stages. A written table keeps column
    pruning and filter pushdown for its readers, and lost executors do not lose it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
