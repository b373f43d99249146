"""WARC archives in Zstandard with an embedded dictionary.

A dictionary is built from a bounded sample of records. Every archive starts with a skippable
frame that holds the dictionary; each record follows in a frame of its own, so an archive can
be read by itself and from any record on. Payloads that were archived before are written as
revisit records without the payload.

Tasks write archives straight to the shared folder and return a manifest, which Spark commits;
only archives in the manifest count, so files of lost or repeated attempts are ignored.

Defined cases: a null payload is empty; a null URL leaves its header out; line ends and other
controls in a URL are percent-encoded; payloads below ``min_revisit_bytes`` are always
responses; of equal payloads the smallest id is the response, and rows that repeat this id
are responses too; a null id is archived, as a response if its payload has no other id; an
empty table gives no archive; with too few samples the dictionary is their plain bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import hash_sample
from tracelake.storage import scratch_path

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
DICTIONARY_BYTES = 1 << 16
#: Records that the dictionary is built from and the most bytes that each gives to it.
SAMPLE_ROWS, SAMPLE_BYTES = 1_000, 1 << 15
#: A new archive is begun after so many compressed bytes.
ARCHIVE_BYTES = 1 << 25
LEVEL = 3
_CHUNK = 1 << 16
_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

_MANIFEST = "path string, n_records long, n_bytes long"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record in the WARC 1.1 format; headers without a value are left out."""
    head = [f"WARC-Type: {kind}"]
    head += [f"{name}: {value}" for name, value in headers if value is not None]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(row: dict, date: str) -> bytes:
    """The response or revisit record of a page."""
    payload = row["payload"]
    uri = row["url"] and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])
    revisit = row["refers_to"] is not None
    headers = [
        ("WARC-Record-ID", f"<urn:page:{row['id']}>"),
        ("WARC-Target-URI", uri),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{row['refers_to']}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    head = _HEAD.format(len(payload)).encode()
    return record("revisit" if revisit else "response", headers, head if revisit else head + payload)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' last bytes where there are too few to train."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Writer:
    """Compresses records one by one behind a frame with the dictionary."""

    def __init__(self, out, dictionary: bytes, level: int = LEVEL):
        self.out, self.size, self.records = out, 0, 0
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.context = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.context.compress(data))
        self.records += 1


def read_records(source):
    """Yield ``(headers, block)`` of an archive, one frame at a time.

    Memory holds one record and a chunk of compressed bytes.
    """
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = source.read(size)
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    context = zstandard.ZstdDecompressor(dict_data=data)
    chunk = source.read(_CHUNK)
    while chunk:
        frame, parts = context.decompressobj(), []
        while not frame.eof:
            if not chunk:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(chunk))
            chunk = frame.unused_data if frame.eof else source.read(_CHUNK)
        chunk = chunk or source.read(_CHUNK)
        yield parse_record(b"".join(parts))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    length = int(headers["Content-Length"])
    if version != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:length]


def plan_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """``id, url, payload, digest, refers_to``; the last is null for responses."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    repeated = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # null ids are not "first"; they revisit it like any other.
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(repeated, "digest", "left").select("id", "url", "payload", "digest", refers.alias("refers_to"))


def sample_dictionary(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> bytes:
    """A dictionary from a bounded sample of the payloads, chosen by hash order."""
    text = F.col(f"`{payload_col}`")
    head = F.encode(F.substring(text, 1, SAMPLE_BYTES), "UTF-8").alias("head")
    rows = pages.filter(text.isNotNull()).select(F.col(f"`{id_col}`").alias("id"), head)
    heads = hash_sample(rows, SAMPLE_ROWS, "id", of=pages.count()).collect()
    return build_dictionary([bytes(r["head"])[:SAMPLE_BYTES] for r in heads])


def write_archives(
    records: DataFrame,
    folder: str,
    dictionary: bytes,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``plan_records`` as archives below ``folder``; the manifest is the result.

    A file is named anew by each attempt, and the manifest, a table of Spark's, names those
    of the attempts that were committed.
    """
    spark = records.sparkSession

    def run(batches):
        files, place = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        out = writer = path = None

        def close():
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"path": path, "n_records": writer.records, "n_bytes": writer.size}]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    path = f"{folder}/{name}"
                    out = files.open_output_stream(f"{place}/{name}", compression=None)
                    writer = Writer(out, dictionary)
                writer.add(page_record(row, date))
                if writer.size >= archive_bytes:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    manifest = f"{folder}/manifest"
    records.mapInArrow(run, _MANIFEST).write.parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def read_archives(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Every page record of the archives, checked against its digest.

    ``id, url, payload_bytes, payload_digest, record_type, refers_to, payload``; the payload
    of a revisit is null, its size and digest are those of the full payload.
    """
    schema = (
        "id string, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to string, payload binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(path):
        files, place = pyarrow.fs.FileSystem.from_uri(path)
        with files.open_input_stream(place, compression=None) as source:
            for headers, block in read_records(source):
                head, _, payload = block.partition(b"\r\n\r\n")
                revisit = headers["WARC-Type"] == "revisit"
                size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{path}: a payload differs from its digest")
                ids = [headers.get(h, "")[10:-1] for h in ("WARC-Record-ID", "WARC-Refers-To")]
                ids = [i if i not in ("", "None") else None for i in ids]
                yield (
                    ids[0], headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"],
                    ids[1], None if revisit else payload,
                )

    def run(batches):
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size >= 1 << 22 or len(held) >= 4096:
                        yield _batch(held, names, types)
                        held, size = [], 0
                if held:
                    yield _batch(held, names, types)

    # One row is one archive of bounded size, so archives are spread evenly over the tasks.
    found = manifest.select("path").repartition(max(1, _tasks(manifest)), "path").mapInArrow(run, schema)
    return found.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def _tasks(manifest: DataFrame) -> int:
    return int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def archive(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, id_col: str = "page_id"
) -> DataFrame:
    """Build the dictionary, write the archives of ``pages`` and return their manifest."""
    folder = folder or scratch_path(spark, "warc")
    return write_archives(plan_records(pages, id_col), folder, sample_dictionary(pages, id_col))
