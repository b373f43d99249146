"""Files as rows: tasks list folders, read and write files and check outputs, so the driver holds no list of them.

Tasks open the stores of ``DIRECT`` by themselves (local and mounted folders, HDFS, object stores);
``direct`` tells whether a path is one of them. For other stores the callers fall back on Spark's own
readers, which list on the driver.
"""

from __future__ import annotations

import csv
import io
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources import tables
from tracelake.storage import materialize

DIRECT = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")
_ENTRY = "path string, bytes long, folder boolean"
#: The folder of a file that a task has written, its name below the root and the file's.
_WRITTEN = "staged string, folder string, name string"
#: Bytes per checksum of Hadoop's local files, and what its escaped folder names replace.
_CHUNK, _ESCAPED = 512, re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def _scheme(path: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return found.group(1).lower() if found else ""


def direct(path: str) -> bool:
    """Whether tasks can open the path without Spark's readers."""
    return _scheme(path) in DIRECT


@lru_cache(maxsize=64)
def _store(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, kept per worker, and the path inside it."""
    scheme = _scheme(path)
    if scheme in ("", "file"):
        return _store("file:///"), re.sub(r"^file:/*", "/", path)
    host, _, inner = path.split("://", 1)[1].partition("/")
    kind = "s3" if scheme == "s3a" else scheme
    found = _store(f"{kind}://{host}/")
    return found, inner if kind == "hdfs" else f"{host}/{inner}"


def read_whole(path: str) -> bytes:
    store, inner = opened(path)
    with store.open_input_stream(inner, compression=None) as stream:
        return stream.read()


def read_pieces(path: str, size: int) -> Iterator[bytes]:
    """The file from its begin in pieces of ``size`` bytes; what is not asked for is not read."""
    store, inner = opened(path)
    with store.open_input_stream(inner, compression=None, buffer_size=0) as stream:
        while piece := stream.read(size):
            yield piece


def _entries(store: fs.FileSystem, inner: str) -> Iterator[tuple[str, int, bool]]:
    """Name, bytes and kind of what lies in a folder, hidden entries left out; no local folder is held as a whole."""
    if not isinstance(store, fs.LocalFileSystem):
        for i in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if not i.base_name.startswith(("_", ".")):
                yield i.base_name, i.size or 0, i.type == fs.FileType.Directory
    elif os.path.exists(inner):
        with os.scandir(inner) as found:
            for i in found:
                if not i.name.startswith(("_", ".")):
                    folder = i.is_dir()
                    # A link to nothing is no entry.
                    if folder or os.path.exists(i.path):
                        yield i.name, 0 if folder else i.stat().st_size, folder


def _list(batches, most: int = 10_000):
    """The entries of every folder; those of small folders share a batch."""

    def entries():
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for name, size, folder in _entries(*opened(path)):
                    yield f"{path.rstrip('/')}/{name}", size, folder

    found = entries()
    while some := list(islice(found, most)):
        kinds = (pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], ["path", "bytes", "folder"])


def _spread(folders: DataFrame) -> DataFrame:
    parts = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folders.select("path").repartition(parts, "path")


def list_level(folders: DataFrame) -> DataFrame:
    """``(path, bytes, folder)`` of what lies in the folders (``path``), hidden entries left out."""
    return _spread(folders).mapInArrow(_list, _ENTRY)


def list_one_below(spark: SparkSession, root: str) -> DataFrame:
    """``(path, bytes)`` of the files that lie exactly one folder below the root."""
    top = spark.createDataFrame([(root,)], "path string").mapInArrow(_list, _ENTRY)
    return list_level(top.filter("folder")).filter("NOT folder").drop("folder")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, bytes)`` of all files below the root, level by level."""
    level = materialize(spark.createDataFrame([(root,)], "path string").mapInArrow(_list, _ENTRY), "listing")
    found = []
    while True:
        found.append(level.filter("NOT folder").drop("folder"))
        folders = level.filter("folder")
        if folders.isEmpty():
            break
        level = materialize(list_level(folders), "listing")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows


def folder_name(key: str, value: str | None) -> str:
    """``key=value`` as Spark names the folder of a value."""
    text = _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"
    return f"{key}={text}"


def _sums_path(inner: str) -> str:
    folder, _, name = inner.rpartition("/")
    return f"{folder}/.{name}.crc"


class _Output:
    """A local file of any length, beside the checksums that Hadoop keeps and checks there."""

    def __init__(self, store: fs.FileSystem, inner: str):
        # Nothing is held back: most files are one piece.
        self.stream, self.sums = (store.open_output_stream(p, compression=None, buffer_size=0) for p in (inner, _sums_path(inner)))
        self.found, self.rest = b"crc\0" + struct.pack(">i", _CHUNK), b""

    def _sum(self, data: bytes) -> None:
        self.found += b"".join(struct.pack(">I", zlib.crc32(data[k : k + _CHUNK])) for k in range(0, len(data), _CHUNK))

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        data = self.rest + data
        whole = len(data) // _CHUNK * _CHUNK
        self._sum(data[:whole])
        self.rest = data[whole:]
        if len(self.found) > 1 << 16:
            self.sums.write(self.found)
            self.found = b""

    def close(self) -> None:
        self.stream.close()
        self._sum(self.rest)
        self.sums.write(self.found)
        self.sums.close()


def _pieces(batches) -> Iterator[tuple[str, bytes]]:
    """Runs of rows of one ``value`` with their lines as one piece; a run may go on in the next batch."""
    for batch in batches:
        if not len(batch):
            continue
        values = batch.column("value")
        lines = batch.column("line").cast(pa.large_binary())
        # The lines of a column lie one behind the other.
        text = lines.buffers()[2] or b""
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        other = pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(lines)]
        for value, a, b in zip(values.take(pa.array(cuts[:-1])).to_pylist(), cuts, cuts[1:]):
            yield value, bytes(memoryview(text)[ends[a] : ends[b]])


def _stager(stage: str, run: str, key: str, header: bytes):
    """Tasks that write a file per run of rows, each in its folder below a folder of the task."""

    def write(batches):
        # A repeated task has another folder; the rows of the one that counts name its files.
        number, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        mine, name = f"{stage}/{number}-{attempt}", f"part-{number:05d}-{run}.csv"
        store, inner = opened(mine)

        def files():
            last, folder, out = None, None, None
            for value, lines in _pieces(batches):
                if out is None or value != last:
                    if out is not None:
                        out.close()
                        yield f"{mine}/{folder}", folder, name
                    last, folder, lines = value, folder_name(key, value), header + lines
                    store.create_dir(f"{inner}/{folder}", recursive=out is None)
                    out = _Output(store, f"{inner}/{folder}/{name}")
                out.write(lines)
            if out is not None:
                out.close()
                yield f"{mine}/{folder}", folder, name

        found = files()
        while some := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["staged", "folder", "name"])

    return write


def _move(store: fs.FileSystem, source: str, target: str, file: str) -> None:
    """A repeated task finds the target's file there."""
    try:
        store.move(source, target)
    except OSError:
        if store.get_file_info(file).type != fs.FileType.File:
            raise


def _mover(root: str):
    """Move folders below the root; the files of one that is there already join its files."""

    def move(batches):
        for batch in batches:
            store, inner = opened(root)
            for staged, folder, name in zip(*(c.to_pylist() for c in batch.columns)):
                source, target = opened(staged)[1], f"{inner}/{folder}"
                if store.get_file_info(target).type == fs.FileType.NotFound:
                    _move(store, source, target, f"{target}/{name}")
                    continue
                # A file is not there without its checksums.
                sums = _sums_path(f"{target}/{name}")
                _move(store, _sums_path(f"{source}/{name}"), sums, sums)
                _move(store, f"{source}/{name}", f"{target}/{name}", f"{target}/{name}")
            yield batch.select(["staged"])

    return move


def append_folders(lines: DataFrame, root: str, key: str, header: list[str]) -> None:
    """Write CSV files below a local or mounted root, as Spark's writer does: a folder ``key=<value>`` per value.

    ``lines`` has ``value`` and ``line`` (a whole row of CSV with its line end); within a partition equal values
    lie together, and every partition gives a value one file. Part files of a folder have the order of the partitions.
    The files are written beside the folders, then moved by tasks once all of them are whole, so that no list and no
    file passes the driver; what is there stays. A write that fails before leaves nothing.
    """
    spark, run, root = lines.sparkSession, uuid.uuid4().hex[:16], root.rstrip("/")
    first = io.StringIO()
    csv.writer(first, lineterminator="\n").writerow(header)
    stage = f"{root}/_temporary-{run}"
    try:
        rows = lines.select(F.coalesce("value", F.lit("")).alias("value"), "line")
        done = rows.mapInArrow(_stager(stage, run, key, first.getvalue().encode()), _WRITTEN)
        done = materialize(done, "written")
        # One task has all files of a folder.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        done.repartition(parts, "folder").mapInArrow(_mover(root), "staged string").agg(F.count("*")).first()
    finally:
        tables.remove(spark, stage)
    tables.mark(spark, f"{root}/_SUCCESS")


def _footers(batches):
    for batch in batches:
        counts = []
        for path in batch.column("path").to_pylist():
            try:
                store, inner = opened(path)
                with store.open_input_file(inner) as file:
                    counts.append(pq.ParquetFile(file).metadata.num_rows)
            except (OSError, pa.ArrowException):
                counts.append(None)
        rows = pa.array(counts, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "bytes")), rows], ["path", "bytes", "rows"])


def parquet_footers(listing: DataFrame) -> DataFrame:
    """``(path, bytes, rows)`` of Parquet files; ``rows`` is null where the footer cannot be read.

    Tasks read the footers only, whatever the size of the files.
    """
    parts = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = listing.select("path", "bytes").repartition(parts, "path")
    return rows.mapInArrow(_footers, "path string, bytes long, rows long")


def _delete(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, inner = opened(path)
            if store.get_file_info(inner).type == fs.FileType.File:
                store.delete_file(inner)
        yield batch


def delete_files(files: DataFrame) -> int:
    """Delete the files (``path``) by tasks; a repeated task finds them gone. Returns their number."""
    return files.select("path").mapInArrow(_delete, "path string").agg(F.count("*")).first()[0]
