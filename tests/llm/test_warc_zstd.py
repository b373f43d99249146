import hashlib
import io
import struct

import pytest
import zstandard

from check import compare, database
from tracelake.llm import warc_zstd as warc
from tracelake.llm.common import table
from tracelake.llm.queries import ORACLE, op7_warc_zstd

from .conftest import SF


def test_query_equals_sql(spark):
    sf = SF.replace("0.001", "0.01")
    assert compare(op7_warc_zstd(spark, sf), database(sf), ORACLE["op7_warc_zstd"]) == ""


def test_round_trip_and_revisits(spark, tmp_path):
    long = "<p>" + "déjà vu " * 30_000
    rows = [
        (3, "http://a/b c\r\nX: y", "x" * 100), (1, None, "x" * 100), (2, "u", "x" * 99), (4, "u", "x" * 99),
        (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (8, "u", long), (None, "u", long),
        (9, "u", "a\r\n\r\nContent-Length: 7\r\n\r\n" * 9),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 AS id", "'z' AS payload", "2 AS digest")
    manifest = warc.archive(spark, pages, f"file://{tmp_path}/out")
    got = warc.read_archives(manifest).collect()
    kept = {r["id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert kept == {1: "x" * 100, 2: "x" * 99, 4: "x" * 99, 5: "", 6: "", 7: long, 9: rows[-1][2]}
    assert sorted((str(r["id"]), r["refers_to"]) for r in got if r["record_type"] == "revisit") == [
        ("3", 1), ("8", 7), ("8", 7), ("None", 7),
    ]
    for r in got:
        html = {str(i): h or "" for i, _, h in rows}[str(r["id"])].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha256(html).hexdigest())
    assert {r["url"] for r in got} == {None, "u", "http://a/b%20c%0D%0AX:%20y"}


def test_archive_format(spark, tmp_path):
    pages = table(spark, SF, "pages")
    manifest = warc.archive(spark, pages, f"file://{tmp_path}/out").collect()
    assert sum(r["n_records"] for r in manifest) == pages.count()
    for r in manifest:
        data = open(r["path"].removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert (magic, len(data)) == (0x184D2A5D, r["n_bytes"])
        dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        assert dictionary.dict_id()
        frames, rest = 0, data[8 + size :]
        while rest:  # every frame by itself is one whole record
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            warc.parse_record(one.decompress(rest))
            rest, frames = one.unused_data, frames + 1
        assert frames == r["n_records"]


def test_dictionary_saves_space_and_small_samples_work():
    samples = [f"<html><head><title>{i}</title></head><body class='page'>{i * i}</body>".encode() for i in range(500)]
    sizes = []
    for dictionary in (warc.build_dictionary(samples, 4096), warc.build_dictionary(samples[:2], 4096), b""):
        out = io.BytesIO()
        writer = warc.Writer(out, dictionary)
        for s in samples:
            writer.add(warc.record("response", [], s))
        sizes.append(out.tell())
        out.seek(0)
        assert [block for _, block in warc.read_records(out)] == samples
    assert sizes[0] < sizes[2] and sizes[1] < sizes[2]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(out.getvalue()[:-3])))


def test_empty_table(spark, tmp_path):
    pages = table(spark, SF, "pages").limit(0)
    assert warc.read_archives(warc.archive(spark, pages, f"file://{tmp_path}/none")).count() == 0
