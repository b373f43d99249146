"""Removal of repeated byte strings by bucket-pointer refinement.

Every string of ``min_bytes`` bytes that starts at two places is removed wherever it starts.
As in bucket-pointer refinement of suffixes, places are first put into buckets by a q-gram
(q is half of ``min_bytes``), and buckets are refined by what stands at other offsets until
each is settled. Not every place is carried along: of the q-grams within a window of
``min_bytes`` the one of least hash stands for it, so equal windows meet in one bucket. The
windows with the same least gram are a run; its bytes are its segment.

1. Buckets of one gram are settled: none of their windows occurs again.
2. Buckets are refined by their segments. Equal segments are settled: all their windows repeat.
3. What is left (a gram occurs again, its surroundings differ) is refined by the windows
   themselves: in tasks that each hold whole buckets, or, for buckets too large for a task, by
   counting windows in a shuffle. Both give the same result.

The rounds carry hashes; bytes are read again only for the segments of step 3. Hashes of
bucket and string together have 119 bits or more.

Defined cases: a null or empty text has no bytes and nothing removed; rows that repeat an id
count as documents of their own, as do rows with a null id; texts are taken in parts of bounded
size, which changes no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import SLAB_BYTES, partitions, slabs, written
from tracelake.llm.components import sorted_runs
from tracelake.llm.words import prefix_hashes, span_hash

_U = np.uint64
MIN_BYTES = 400
#: Segments of a bucket that one task refines to the end.
BUCKET_ROWS = 8_192
#: Low bits of a gram's hash that give way to its place, so that ties are told apart.
_TIE = 9
_TIE_MASK = (1 << _TIE) - 1
_TIE_STEP = 301
_TIE_BACK = pow(_TIE_STEP, -1, 1 << _TIE)
_LAST = _U(0xFFFFFFFFFFFFFFFF)

_RUN = "key long, gram long, segment long, start long, run int, anchor int, places int"
_SPAN = "key long, begin long, end long"
SPANS = "array<struct<begin:bigint,end:bigint>>"


def document_key(id_col: str, text_col: str) -> Column:
    """What a document is known by between the rounds."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values)
    filled = np.full(-(-n // width) * width, _LAST)
    filled[:n] = values
    rows = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def find_runs(raw: np.ndarray, offsets: np.ndarray, min_bytes: int):
    """Runs of windows with the same least gram, over texts that lie end to end.

    Returns ``(text, gram, segment, start, run, anchor, places)``: gram and segment hashes, the
    first window's place, the number of windows, how far the gram lies behind the first window,
    and 2 if the gram occurs in the run again, else 1. None if no text has a window.
    """
    q = min_bytes // 2
    windows = len(raw) - min_bytes + 1
    if windows < 1:
        return None
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    inside = np.arange(windows) + min_bytes <= offsets[1:][text]
    if not inside.any():
        return None
    prefix = prefix_hashes(raw)
    at = np.arange(len(raw) - q + 1)
    gram = span_hash(prefix, at, at + q) & ~_U(_TIE_MASK) | ((at * _TIE_STEP) & _TIE_MASK).astype(np.uint64)
    width = min_bytes - q + 1
    least = sliding_least(gram, width)
    fresh = np.ones(windows, bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(fresh)
    ends = np.append(first[1:], windows)
    use = inside[first]
    first, ends = first[use], ends[use]
    value = least[first]
    residue = ((value & _U(_TIE_MASK)).astype(np.int64) * _TIE_BACK) & _TIE_MASK
    anchor = (residue - first) & _TIE_MASK
    rest = gram.copy()
    rest[first + anchor] = _LAST
    again = np.concatenate([[0], np.cumsum(sliding_least(rest, width) >> _U(_TIE) == least >> _U(_TIE))])
    places = 1 + (again[ends] > again[first])
    segment = span_hash(prefix, first, ends - 1 + min_bytes)
    return text[first], value >> _U(_TIE), segment, first, ends - first, anchor, places


def parts(raw: np.ndarray, offsets: np.ndarray, min_bytes: int, limit: int):
    """A slab of texts, or overlapping parts of one long text: ``(shift, bytes, offsets)``."""
    if len(offsets) > 2 or len(raw) <= limit + min_bytes:
        yield 0, raw, offsets
        return
    for at in range(0, len(raw) - min_bytes + 1, limit):
        part = raw[at : at + limit + min_bytes - 1]
        yield at, part, np.array([0, len(part)])


def window_runs(docs: DataFrame, min_bytes: int, limit: int = SLAB_BYTES) -> DataFrame:
    """The runs of every document (``key, text``)."""

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column("key"))
            for begin, _, whole, all_offsets in slabs(batch, limit=limit):
                for shift, raw, offsets in parts(whole, all_offsets, min_bytes, limit):
                    found = find_runs(raw, offsets, min_bytes)
                    if found is None:
                        continue
                    text, gram, segment, first, length, anchor, places = found
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[begin + text]),
                            pa.array(gram.view(np.int64)),
                            pa.array(segment.view(np.int64)),
                            pa.array(first - offsets[text] + shift),
                            *(pa.array(x.astype(np.int32)) for x in (length, anchor, places)),
                        ],
                        ["key", "gram", "segment", "start", "run", "anchor", "places"],
                    )

    return docs.mapInArrow(run, _RUN)


def segments(docs: DataFrame, wanted: DataFrame, min_bytes: int) -> DataFrame:
    """``bucket, key, start, open, large, bytes`` of the wanted runs."""
    lists = wanted.groupBy("key").agg(
        F.collect_list(F.struct("gram", "start", "run", "open", "large")).alias("runs")
    )
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    names = ["bucket", "key", "start", "open", "large", "bytes"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            keys, lists = batch.column("key").to_pylist(), batch.column("runs").to_pylist()
            held, size = [], 0
            for key, text, runs in zip(keys, texts, lists):
                text = text.as_py()
                for r in runs:
                    piece = text[r["start"] : r["start"] + r["run"] - 1 + min_bytes]
                    held.append((r["gram"], key, r["start"], r["open"], r["large"], piece))
                    size += len(piece)
                    if size >= SLAB_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
            if held:
                yield batch_of(held)

    schema = "bucket long, key long, start long, open boolean, large boolean, bytes binary"
    return docs.join(lists, "key").select("key", "text", "runs").mapInArrow(run, schema)


def windows_of(rows: pa.Table, min_bytes: int):
    """Hash of every window of a table's segments, its segment, and each segment's first."""
    pieces = rows.column("bytes").to_pylist()
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    counts = lengths - min_bytes + 1
    segment = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.arange(first[-1]) + (bounds[:-1] - first[:-1])[segment]
    prefix = prefix_hashes(np.frombuffer(b"".join(pieces), np.uint8))
    return span_hash(prefix, start, start + min_bytes), segment, first


def flagged_spans(flags: np.ndarray, segment: np.ndarray, first, keys, starts, min_bytes: int) -> pa.RecordBatch:
    """Spans of the bytes under runs of flagged windows."""
    edge = np.ones(len(flags) + 1, bool)
    edge[1:-1] = segment[1:] != segment[:-1]
    opens, closes = flags.copy(), flags.copy()
    opens[1:] &= ~flags[:-1] | edge[1:-1]
    closes[:-1] &= ~flags[1:] | edge[1:-1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    own = segment[a]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[own]),
            pa.array(starts[own] + a - first[own]),
            pa.array(starts[own] + b - first[own] + min_bytes),
        ],
        ["key", "begin", "end"],
    )


def refined_in_tasks(rows: DataFrame, min_bytes: int) -> DataFrame:
    """Spans of repeated windows in open segments; each bucket is held by one task."""

    def run(batches):
        for table, bounds in sorted_runs(batches, "bucket"):
            window, segment, first = windows_of(table, min_bytes)
            bucket = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[segment]
            order = np.lexsort((window, bucket))
            same = (window[order][1:] == window[order][:-1]) & (bucket[order][1:] == bucket[order][:-1])
            flags = np.zeros(len(window), bool)
            flags[order[1:][same]] = True
            flags[order[:-1][same]] = True
            flags &= np.asarray(table.column("open"))[segment]
            keys, starts = np.asarray(table.column("key")), np.asarray(table.column("start"))
            yield flagged_spans(flags, segment, first, keys, starts, min_bytes)

    dealt = rows.repartition(partitions(rows), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, _SPAN)


def refined_by_shuffle(rows: DataFrame, min_bytes: int) -> DataFrame:
    """The same for buckets of any size: windows are counted by Spark."""
    names = ["bucket", "window", "key", "start", "place", "open"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                table = pa.Table.from_batches([batch.slice(at, 256)])
                window, segment, first = windows_of(table, min_bytes)
                columns = [np.asarray(table.column(c))[segment] for c in ("bucket", "key", "start", "open")]
                place = (np.arange(len(window)) - first[segment]).astype(np.int32)
                columns = [columns[0], window.view(np.int64), *columns[1:3], place, columns[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    windows = rows.mapInArrow(run, "bucket long, window long, key long, start long, place int, open boolean")
    alone = windows.groupBy("bucket", "window").agg(
        F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("key", "start", "place", "open"))
    )
    alone = alone.filter("n = 1 AND open").groupBy("key", "start").agg(F.collect_list("place").alias("alone"))
    left = rows.filter("open").select("key", "start", (F.octet_length("bytes") - min_bytes + 1).alias("run"))

    def spans(batches):
        for batch in batches:
            run_, lists = np.asarray(batch.column("run")), batch.column("alone").to_pylist()
            if not len(run_):
                continue
            first = np.concatenate([[0], np.cumsum(run_)])
            segment = np.repeat(np.arange(len(run_)), run_)
            flags = np.ones(first[-1], bool)
            for k, places in enumerate(lists):
                if places:
                    flags[first[k] + np.array(places)] = False
            keys, starts = np.asarray(batch.column("key")), np.asarray(batch.column("start"))
            yield flagged_spans(flags, segment, first, keys, starts, min_bytes)

    return left.join(alone, ["key", "start"], "left").mapInArrow(spans, _SPAN)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES
) -> DataFrame:
    """``key, spans`` of every document with repeated strings; spans may overlap."""
    keyed = docs.select(document_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    keyed = keyed.filter(F.octet_length("text") >= min_bytes)
    runs = written(window_runs(keyed, min_bytes), "runs")
    grams = runs.groupBy("gram").agg(
        F.sum("places").alias("places"), F.min("segment").alias("low"), F.max("segment").alias("high")
    )
    again = written(runs.drop("places").join(grams.filter("places > 1").drop("places"), "gram"), "again")

    buckets = again.groupBy("gram", "segment").agg(
        F.count("*").alias("n"),
        F.min(F.struct("key", "start", "run")).alias("one"),
        (F.min("low") < F.max("high")).alias("varied"),
    )
    buckets = written(buckets, "segments")
    settled = again.join(buckets.filter("n > 1").select("gram", "segment"), ["gram", "segment"])
    settled = settled.select("key", F.col("start").alias("begin"), (F.col("start") + F.col("run") - 1 + min_bytes).alias("end"))

    work = buckets.filter("n = 1 OR varied").select("gram", "one.*", (F.col("n") == 1).alias("open"))
    sizes = work.groupBy("gram").agg((F.count("*") > BUCKET_ROWS).alias("large"))
    rows = written(segments(keyed, work.join(sizes, "gram"), min_bytes), "open")
    spans = settled.union(refined_in_tasks(rows.filter("NOT large"), min_bytes))
    spans = spans.union(refined_by_shuffle(rows.filter("large"), min_bytes))
    # Repeated rows of one id and text have the same spans.
    return spans.distinct().groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def cut(text: Column, spans: Column) -> Column:
    """``struct<kept: binary, text: string, spans>``: what is left, and the maximal removed runs.

    ``text`` leaves out characters of which a removed run took a part.
    """
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("kept", pa.binary()), ("text", pa.string()), ("spans", pa.list_(span))])

    @F.arrow_udf(f"struct<kept:binary,text:string,spans:{SPANS}>")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.cast(pa.binary()), lists):
            text, merged = text.as_py() or b"", []
            for begin, end in sorted((s["begin"], s["end"]) for s in spans.as_py() or ()):
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([begin, end])
            kept, at = [], 0
            for begin, end in merged:
                kept.append(text[at:begin])
                at = end
            kept.append(text[at:])
            whole = "".join(part.decode("utf-8", "ignore") for part in kept)
            runs = [{"begin": b, "end": e} for b, e in merged]
            out.append({"kept": b"".join(kept), "text": whole, "spans": runs})
        return pa.array(out, kind)

    return run(text, spans)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES
) -> DataFrame:
    """All columns of ``docs`` and ``cut`` (bytes and text left, and spans removed)."""
    spans = repeated_spans(docs, id_col, text_col, min_bytes)
    spans = spans.select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    rows = docs.drop("cut").withColumn("__key", document_key(id_col, text_col)).join(spans, "__key", "left")
    return rows.withColumn("cut", cut(F.col(f"`{text_col}`"), F.col("__spans"))).drop("__key", "__spans")
