"""Raw telemetry CSV files, one per job and node.

Every file is a row, read by one task: its columns are chosen by its own header, so files of any
number of layouts take one pass. A file is parsed to its end before a row of it is given away, so a
file that cannot be read to its end, has no header or lacks a column gives a status and no row.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import storage
from tracelake.schemas import TELEMETRY_CSV
from tracelake.sources import files as stored
from tracelake.sources import tables

COLUMNS = TELEMETRY_CSV.fieldNames()
#: Bytes of files that one task reads, about, and those that a probe reads at a time.
TASK_BYTES, PROBE_BYTES = 256 << 20, 16 << 10
#: Bytes of files that are parsed together, about, and of the largest of them that shares a pass.
HELD_BYTES, SMALL_BYTES = 2 << 20, 64 << 10
#: States of a file.
OK, UNREADABLE, EMPTY, LACKING = "ok", "unreadable", "empty", "missing columns"

_SEQ = "struct<file:string,row:bigint>"
_TEXTS = ", ".join(f"{c} string" for c in COLUMNS)
_FILE = "job_id string, node_id string, path string, bytes long"
#: A file's samples have a row number and the file's name as path; its one row without a number has its whole
#: path, its state and the number of samples.
_ROW = f"job_id string, node_id string, path string, row long, status string, n_rows long, {_TEXTS}"


def _unit(layout: str, path: Column) -> Column:
    """The ``<job>-<node>`` text: the file stem, or the value of its folder."""
    name = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    if layout == "folder":
        return F.substring_index(folder, "=", -1)
    return F.substring(name, F.lit(1), F.length(name) - len(".csv"))


def _with_keys(df: DataFrame, layout: str, path: Column) -> DataFrame:
    """Add ``job_id`` (digits before the first dash) and ``node_id`` (the rest); rows
    whose unit has another form are dropped.

    Where a node is a file, its folder is part of ``node_id``: two files of one name in two
    folders are two nodes.
    """
    dash = F.instr(F.col("_unit"), "-")
    node = F.substring("_unit", dash + 1, F.length("_unit"))
    named = F.col("_unit").isNotNull() & (node != "")
    if layout == "file":
        folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
        node = F.concat(folder, F.lit("/"), node)
    keyed = df.withColumn("_unit", _unit(layout, path)).filter(named).select(
        *df.columns, F.substring("_unit", F.lit(1), dash - 1).alias("job_id"), node.alias("node_id")
    )
    digits_only = F.translate("job_id", "0123456789", "") == ""
    return keyed.filter((F.col("job_id") != "") & digits_only)


def list_nodes(spark: SparkSession, path: str, layout: str = "file") -> DataFrame:
    """``(job_id, node_id, path, bytes)`` of every matching file, empty ones included.

    ``path`` is a folder whose files lie exactly one folder below it. Tasks list the folders; no
    content is read and no list passes the driver. With ``layout="folder"`` the job-node pair is the
    folder's name (``unit=<pair>`` works), and a node has several rows.
    """
    if stored.direct(path):
        found = stored.list_one_below(spark, path)
    else:
        # Spark's scans leave out files of no bytes, its listing does not.
        names = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/*/*.csv").inputFiles()
        found = spark.createDataFrame(pd.DataFrame({"path": names}, dtype=str), "path string")
        found = found.withColumn("bytes", F.lit(None).cast("long"))
    found = found.filter(F.col("path").endswith(".csv"))
    return _with_keys(found, layout, F.col("path")).select("job_id", "node_id", "path", "bytes")


def header_of(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line.lstrip("\ufeff").rstrip("\r\n")]), [])]


def _plain_rows(text: str, places: list[int]) -> list[list[str | None]]:
    """The wanted columns of rows of any length; what a row lacks is null."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    return [[(r[k] or None) if k < len(r) else None for r in rows] for k in places]


@lru_cache(maxsize=256)
def _names(line: bytes) -> tuple[str, ...]:
    return tuple(header_of(line.decode("utf-8", "replace")))


def _opened(content: bytes) -> tuple[str, tuple[str, ...], bytes]:
    """A file's state, the names of its header and what follows it."""
    begin = len(content) - len(content.lstrip(b"\r\n\t "))
    stop = content.find(b"\n", begin)
    stop = len(content) if stop < 0 else stop + 1
    line = content[begin:stop]
    names = _names(line) if len(line) <= SMALL_BYTES else _names.__wrapped__(line)
    if not any(names):
        return EMPTY, names, b""
    if not all(c in names for c in COLUMNS):
        return LACKING, names, b""
    return OK, names, content[stop:]


def _arrow_columns(names: tuple[str, ...], body: bytes) -> list[pa.Array]:
    """Fails on rows of other lengths than the header and on bytes that are no text."""
    places, fields = [names.index(c) for c in COLUMNS], [f"c{k}" for k in range(len(names))]
    table = arrow_csv.read_csv(
        pa.BufferReader(body),
        arrow_csv.ReadOptions(use_threads=False, column_names=fields),
        arrow_csv.ParseOptions(newlines_in_values=b'"' in body),
        arrow_csv.ConvertOptions(
            include_columns=[fields[k] for k in places],
            column_types={fields[k]: pa.string() for k in places},
            strings_can_be_null=True,
            null_values=[""],
            quoted_strings_can_be_null=True,
        ),
    )
    return [c.combine_chunks() for c in table.columns]


def _columns(names: tuple[str, ...], body: bytes) -> list[pa.Array]:
    if not body.strip():
        return [pa.array([], pa.string())] * len(COLUMNS)
    try:
        return _arrow_columns(names, body)
    except pa.ArrowInvalid:
        places = [names.index(c) for c in COLUMNS]
        return [pa.array(c, pa.string()) for c in _plain_rows(body.decode("utf-8", "replace"), places)]


def parse_csv(content: bytes) -> tuple[str, list[pa.Array]]:
    """A file's state and its telemetry columns as text."""
    status, names, body = _opened(content)
    return status, _columns(names, body) if status == OK else []


def _countable(body: bytes) -> bool:
    """Whether a row takes a line at least and no line is blank; true of small files only, as others gain nothing."""
    return (
        0 < len(body) <= SMALL_BYTES
        and not (b"\r" in body or b"\n\n" in body)
        and not body.startswith((b"\n", b"\xef\xbb\xbf"))
    )


def parse_all(contents: list[bytes]) -> list[tuple[str, list[pa.Array]]]:
    """``parse_csv`` of every content; a pass of the parser takes all small files of one header."""
    found, alike = [], defaultdict(list)
    for k, content in enumerate(contents):
        status, names, body = _opened(content)
        if status == OK and _countable(body):
            alike[names].append((k, body if body.endswith(b"\n") else body + b"\n"))
            found.append(None)
        else:
            found.append((status, _columns(names, body) if status == OK else []))
    for names, some in alike.items():
        counts = [body.count(b"\n") for _, body in some]
        try:
            columns = _arrow_columns(names, b"".join(body for _, body in some))
            # As many rows as lines: no value of a file has a line end or goes on in the next file.
            whole = len(columns[0]) == sum(counts)
        except pa.ArrowInvalid:  # at least one file needs another way
            whole = False
        begin = 0
        for (k, body), n in zip(some, counts):
            found[k] = (OK, [c.slice(begin, n) for c in columns] if whole else _columns(names, body))
            begin += n
    return found


def parse_head(pieces: Iterator[bytes], rows: int) -> tuple[str, list[pa.Array]]:
    """The same for the first ``rows`` rows; takes no more pieces than these need."""
    seen = b""
    for piece in pieces:
        seen += piece
        whole = seen[: seen.rfind(b"\n") + 1]
        # The last row may go on in the next piece if it is quoted.
        if whole.strip() and whole.count(b"\n") > rows + 1:
            status, columns = parse_csv(whole)
            if columns and len(columns[0]) > rows:
                return status, [c.slice(0, rows) for c in columns]
            if status != OK:
                return status, []
    status, columns = parse_csv(seen)
    return status, [c.slice(0, rows) for c in columns]


def _rows_of(files: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The samples and states of files as batches of ``_ROW``."""
    names = ["job_id", "node_id", "path", "row", "status", "n_rows", *COLUMNS]
    *keys, status, columns = zip(*files)
    counts = np.array([len(c[0]) if c else 0 for c in columns])
    n = len(files)
    state = [pa.nulls(n, pa.int64()), pa.array(status, pa.string()), pa.array(counts, pa.int64())]
    yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), *state, *[pa.nulls(n, pa.string())] * len(COLUMNS)], names)
    keys[-1] = [path.rsplit("/", 1)[-1] for path in keys[-1]]
    keys = [pa.array(k, pa.string()) for k in keys]
    texts = [pa.chunked_array([c[k] for c in columns if c], pa.string()) for k in range(len(COLUMNS))]
    ends = np.cumsum(counts)
    for k in range(0, int(ends[-1]), 10_000):
        number = np.arange(k, min(k + 10_000, int(ends[-1])))
        file = np.searchsorted(ends, number, "right")
        size = len(number)
        state = [pa.array(number - (ends - counts)[file], pa.int64()), pa.nulls(size, pa.string()), pa.nulls(size, pa.int64())]
        some = [pa.concat_arrays(t.slice(k, size).chunks) for t in texts]
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(file)) for c in keys), *state, *some], names)


def _reader(head: int | None):
    """Tasks that open the files of their rows; ``content`` is there if Spark has read them."""

    def load(path: str) -> bytes | tuple[str, list[pa.Array]]:
        try:
            if head is None:
                return stored.read_whole(path)
            return parse_head(stored.read_pieces(path, PROBE_BYTES), head)
        except OSError:
            return UNREADABLE, []

    def given(content: pa.Scalar) -> bytes | tuple[str, list[pa.Array]]:
        if not content.is_valid:
            return UNREADABLE, []
        if head is None:
            return content.as_py()
        status, columns = parse_csv(content.as_py())
        return status, [c.slice(0, head) for c in columns]

    def rows(files: list[tuple]) -> Iterator[pa.RecordBatch]:
        parsed = iter(parse_all([got for *_, got in files if isinstance(got, bytes)]))
        return _rows_of([(*keys, *(next(parsed) if isinstance(got, bytes) else got)) for *keys, got in files])

    def found(batches):
        held, size = [], 0
        for batch in batches:
            contents = batch.column("content") if "content" in batch.schema.names else None
            keys = [batch.column(c).to_pylist() for c in ("job_id", "node_id", "path")]
            for k, (job, node, path) in enumerate(zip(*keys)):
                got = load(path) if contents is None else given(contents[k])
                held.append((job, node, path, got))
                size += PROBE_BYTES if isinstance(got, tuple) else len(got) + 1_000
                if size >= HELD_BYTES:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return found


def _parsed(nodes: DataFrame, head: int | None, through_spark: bool) -> DataFrame:
    """Rows of ``_ROW``. ``nodes`` are files as ``list_nodes`` gives them."""
    spark = nodes.sparkSession
    rows = nodes.select("job_id", "node_id", "path", F.col("bytes").cast("long").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not through_spark:
        if head is None:
            rows = storage.materialize(rows, "listing")
            size = rows.agg(F.sum("bytes")).first()[0] or 0
            parts = max(parts, -(-size // TASK_BYTES))
        return rows.repartition(parts, "path").mapInArrow(_reader(head), _ROW)
    # A file that fails midway is left out as a whole, since its content is one value.
    paths = [r["path"] for r in rows.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], _ROW)
    whole = spark.read.format("binaryFile").option("ignoreCorruptFiles", True).load(paths)
    whole = whole.select(F.col("path").alias("place"), "content")
    plain = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    joined = rows.withColumn("key", plain(F.col("path"))).join(whole.withColumn("key", plain(F.col("place"))), "key", "left")
    return joined.select("job_id", "node_id", "path", "content").mapInArrow(_reader(head), _ROW)


@dataclass(frozen=True)
class Ingest:
    """``samples`` (keys, ``seq``, texts) of the files that are ``ok``, and the ``status`` of every file."""

    samples: DataFrame
    status: DataFrame


def _samples(rows: DataFrame) -> DataFrame:
    seq = F.struct(F.col("path").alias("file"), "row").alias("seq")
    return rows.filter(F.col("row").isNotNull()).select("job_id", "node_id", seq, *COLUMNS)


def probe(nodes: DataFrame, rows: int, through_spark: bool = False) -> DataFrame:
    """The first ``rows`` samples of every file; the bytes read do not grow with the files."""
    return _samples(_parsed(nodes, rows, through_spark))


def ingest(nodes: DataFrame, through_spark: bool = False) -> Ingest:
    """Read every file once and store what it gives, so that later steps read columns of Parquet.

    A node of several files (one of the folder layout) has samples only if all its files are ``ok``.
    """
    spark, path = nodes.sparkSession, storage.scratch_path(nodes.sparkSession, "telemetry")
    kind = F.when(F.col("row").isNull(), "status").otherwise("sample").alias("kind")
    rows = _parsed(nodes, None, through_spark).withColumn("kind", kind)
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    back = spark.read.schema(f"{_ROW}, kind string").parquet(path)
    status = back.filter("kind = 'status'").select("job_id", "node_id", "path", "status", "n_rows")
    samples = _samples(back.filter("kind = 'sample'"))
    bad = status.groupBy("job_id", "node_id").agg((F.count_if(F.col("status") != OK) > 0).alias("bad"), F.count("*").alias("n"))
    mixed = bad.filter("bad AND n > 1").select("job_id", "node_id")
    if not mixed.isEmpty():
        samples = samples.join(mixed, ["job_id", "node_id"], "left_anti")
    return Ingest(samples, status)


def scan_telemetry(spark: SparkSession, path: str, layout: str = "file") -> DataFrame:
    """Text telemetry with ``job_id``, ``node_id`` and the in-file order ``seq`` of a whole folder."""
    return ingest(list_nodes(spark, path, layout), through_spark=not stored.direct(path)).samples


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(key, bytes)`` of the files below a folder: a manifest or a fetch listing."""
    if stored.direct(path):
        like = F.lit("^" + "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in pattern) + "$")
        rows = stored.list_tree(spark, path).filter(F.regexp(F.substring_index("path", "/", -1), like))
        return rows.select(F.col("path").alias("key"), "bytes")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(F.col("path").alias("key"), F.col("length").alias("bytes"))
    )


def write_telemetry(telemetry: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Write samples as CSV in the folder layout, in sample order, beside what is there.

    ``columns`` are those to write, in their order; as shipped the telemetry columns.

    Range partitioning by (unit, seq) lets several tasks share a heavy node while the
    part files of its folder keep the order of the samples. The task count is explicit:
    the cost is one file per unit, which the shuffled bytes do not show. In a local or mounted
    folder tasks write and move the files: Spark's writer moves them one by one on the driver
    and starts programs there for the rights of every file and folder.
    """
    spark, names = telemetry.sparkSession, columns or COLUMNS
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        telemetry.withColumn("unit", F.concat_ws("-", "job_id", "node_id"))
        .repartitionByRange(parts, "unit", "seq")
        .sortWithinPartitions("unit", "seq")
        .select("unit", *names)
    )
    local = tables.local_path(spark, path)
    if local:
        line = F.concat(F.to_csv(F.struct(*names)), F.lit("\n"))
        stored.append_folders(rows.select(F.col("unit").alias("value"), line.alias("line")), local, "unit", names)
    else:
        rows.write.mode("append").partitionBy("unit").option("header", True).csv(path)
