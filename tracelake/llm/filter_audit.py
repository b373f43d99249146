"""Audit of how five document filters interact, kept up to date as files arrive.

Filter E (identical to the text of a smaller id) depends on rows not seen yet. So the files are
processed as available-now micro-batches of one stream. State, keyed by the SHA-256 of
a text, holds the smallest id so far and what its rows were counted as. A batch that brings a
smaller id retracts the earlier rows from their counter and adds them to the one of the mask
with E. Each batch writes its changes of the counters per part (a row per part, mask and label
flags) to a folder named by the batch, so a repeated batch replaces its own changes. The sum of
the changes is exact after every batch; orders and steps are derived from it.

Rows of one text are added up within each task before they are sent to the text's state, so a
text that fills a third of the table reaches it as a few rows per task. With a ``folder`` of
one's own, a later call reads only files that came since.

Defined cases: a null text counts as empty, a null part as the empty string; a row with a null
id never fails E and makes no other row fail it; rows that share the smallest id of a text all
pass E, every further row of the text fails it; ids are compared as long integers; labels that
are null or belong to no row count nothing, several labels of an id count if one of them does;
an empty table gives no row.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.llm.common import partitions, written
from tracelake.storage import scratch_path

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Label flags of a counter: quality 1, toxic 1.
GOOD, TOXIC = 1, 2
#: Texts that share an entry of the state store, so that Python is called for each bucket and not for each text.
TEXTS = 1_000
#: Keys without an id are spread over so many tasks in the join with labels.
LANES = 64

#: Bytes of state per row of the documents, about, and those that a partition's store on disk reserves for
#: itself: states beyond that lie on the executors' disks, smaller ones in memory. Both have their snapshots in
#: the stream's folder.
STATE_BYTES, RESERVED = 64, 4 << 20
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STORES = "org.apache.spark.sql.execution.streaming.state."
_DELTA = "part string, mask int, flags int, n long"
_SUMS = "digest binary, part string, mask int, flags int, rows long, known boolean, id long, rows_at_id long"
_ROWS = ["digest", "part", "mask", "flags", "rows", "known", "id", "rows_at_id"]
_HELD = ["digest", "part", "mask", "flags", "id", "n"]
_STATE = pa.schema(
    [("digest", pa.binary()), ("part", pa.string()), ("mask", pa.int32()), ("flags", pa.int32()), ("id", pa.int64())]
    + [("n", pa.int64())]
)


def failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [
        n < 100,
        100 * distinct.cast("long") < 80 * n.cast("long"),
        100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0)).cast("int")


def _add_up(batches):
    """Rows of a text within a batch as one per part and flags: all rows, the smallest id, its rows."""
    by = ["digest", "part", "mask", "flags", "known"]
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows.append_column("known", rows.column("id").is_valid())
        rows = rows.group_by([*by, "id"]).aggregate([([], "count_all")]).sort_by("id")
        sums = rows.group_by(by, use_threads=False).aggregate(
            [("count_all", "sum"), ("id", "first"), ("count_all", "first")]
        )
        columns = [sums.column(c) for c in (*by[:4], "count_all_sum", "known", "id_first", "count_all_first")]
        columns[6] = columns[6].fill_null(0)
        yield from pa.Table.from_arrays(columns, _ROWS).combine_chunks().to_batches()


def _update(key, frames, state: GroupState):
    """Changes of the counters by a bucket's new rows.

    The bucket's state has a row for each text, part and flags: how many rows of the text's smallest
    id are counted there, under the mask without E.
    """
    new = pd.concat([f[_ROWS] for f in frames], ignore_index=True)
    held = pa.ipc.open_stream(state.get[0]).read_pandas() if state.exists else new.iloc[:0].rename(columns={"rows": "n"})
    held = held[_HELD]
    text, _ = pd.factorize(pd.concat([held["digest"], new["digest"]], ignore_index=True))
    ids = np.concatenate([held["id"], new["id"]]).astype(np.int64)
    known = np.concatenate([np.ones(len(held), bool), new["known"]]).astype(bool)
    least = np.full(text.max() + 1 if len(text) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, text[known], ids[known])
    first = ids == least[text]
    old_first, new_first = first[: len(held)], first[len(held) :]
    own = np.where(new["known"], np.where(new_first, new["rows_at_id"], 0), new["rows"])
    counted = lambda rows, n, bit: rows.assign(mask=rows["mask"] | bit, n=n)[["part", "mask", "flags", "n"]]
    late = held[~old_first]
    change = pd.concat(
        [
            counted(late, -late["n"], 0),
            counted(late, late["n"], DUPLICATE),
            counted(new, own, 0),
            counted(new, new["rows"] - own, DUPLICATE),
        ]
    )
    kept = pd.concat([held[old_first], new[new_first & new["known"]].assign(n=lambda d: d["rows_at_id"])[_HELD]])
    kept = kept.groupby(_HELD[:-1], sort=False, as_index=False)["n"].sum()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STATE) as writer:
        writer.write_table(pa.Table.from_pandas(kept, _STATE, preserve_index=False))
    state.update((sink.getvalue().to_pybytes(),))
    sums = change.groupby(["part", "mask", "flags"], sort=False, as_index=False)["n"].sum()
    yield sums[sums["n"] != 0]


def label_flags(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per labelled id: ``id, flags``."""
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL")
    return rows.groupBy("id").agg((flag("quality", GOOD) + flag("toxic", TOXIC)).cast("int").alias("flags"))


def changes(
    docs: DataFrame, labels: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Stream of documents to stream of counter changes; ``labels`` has ``id, flags``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), part.alias("part"), text.alias("text"), words.alias("words")
    )
    rows = rows.select(
        "id",
        "part",
        failures(F.col("text"), F.col("words")).alias("mask"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    lane = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest", "part"), F.lit(LANES))).otherwise(0)
    rows = rows.withColumn("lane", lane).join(labels.withColumn("lane", F.lit(0).cast("long")), ["id", "lane"], "left")
    rows = rows.select("id", "part", "mask", "digest", F.coalesce("flags", F.lit(0)).alias("flags"))
    sums = rows.mapInArrow(_add_up, _SUMS)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    return sums.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        _update, _DELTA, "texts binary", "update", GroupStateTimeout.NoTimeout
    )


def orders_and_steps(counters: DataFrame) -> DataFrame:
    """Every order and step of each part from ``part, mask, flags, n``."""
    counters = counters.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    rows = counters.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bits = "transform(sequence(1, 5), k -> shiftleft(1, instr('%s', substring(filter_order, k, 1)) - 1))" % FILTERS
    rows = rows.withColumn("bits", F.expr(bits))
    own = F.element_at("bits", F.col("step"))
    earlier = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a.bitwiseOR(b))
    rows = rows.withColumn("own", own).withColumn("earlier", earlier)
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) > 0, F.col("mask").bitwiseAND(F.col("earlier")) > 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    removed = fails & ~gone
    table = rows.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(removed & (F.col("flags").bitwiseAND(F.lit(GOOD)) > 0)).alias("good_lost"),
        total(removed & (F.col("flags").bitwiseAND(F.lit(TOXIC)) > 0)).alias("toxic_lost"),
    )
    shapley = table.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return table.join(shapley, ["part", "own"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def _buckets(spark: SparkSession, folder: str, wanted: int) -> int:
    """The number of buckets that the folder's first call chose."""
    rows = spark.createDataFrame([(wanted,)], "buckets long")
    rows.write.mode("ignore").parquet(f"{folder}/buckets")
    return spark.read.schema(rows.schema).parquet(f"{folder}/buckets").first()["buckets"]


def audit(
    spark: SparkSession,
    path: str,
    labels: DataFrame,
    folder: str | None = None,
    batches: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """The audit of all Parquet files at ``path``, read in about ``batches`` micro-batches.

    ``folder`` (on storage that all executors reach) keeps state and counters between calls.
    """
    folder = folder or scratch_path(spark, "filter-audit")
    schema = spark.read.parquet(path).schema
    size = spark.read.parquet(path).agg(
        F.count("*").alias("rows"), F.count_distinct("_metadata.file_path").alias("files")
    ).first()
    flags = written(label_flags(labels, id_col), "label-flags")
    # A file stream takes folders and patterns; as a pattern the path may also name one file.
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    per_batch = max(1, -(-size["files"] // batches))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(pattern)

    def store(change: DataFrame, batch: int) -> None:
        sums = change.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).filter("n <> 0")
        sums.write.mode("overwrite").parquet(f"{folder}/counters/batch={batch}")

    buckets = _buckets(spark, folder, max(1, -(-size["rows"] // TEXTS)))
    spark.createDataFrame([], _DELTA).write.mode("overwrite").parquet(f"{folder}/counters/batch=-1")
    provider, large = spark.conf.get(_PROVIDER), size["rows"] * STATE_BYTES > partitions(flags) * RESERVED
    # A stream that goes on keeps the kind of store it began with.
    spark.conf.set(_PROVIDER, _STORES + ("RocksDBStateStoreProvider" if large else "HDFSBackedStateStoreProvider"))
    try:
        query = (
            changes(stream, flags, buckets, id_col, text_col, part_col)
            .writeStream.foreachBatch(store)
            .outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, provider)
    counters = spark.read.schema(f"{_DELTA}, batch int").parquet(f"{folder}/counters")
    return orders_and_steps(counters)
