"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns the rows that go on; all but the last
return the columns of ``docs``. Rows with a null id go through all stages; near duplicates are
only sought among rows with an id, and rows that repeat an id stay or go together. A null text
is rejected with the empty ones; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import minhash_hamming, rule_forest, suffix_buckets, swap_packing, toxicity_mil
from tracelake.llm.common import table, written

#: Documents with such a score or more are toxic.
TOXIC = 0.5
#: Percent of shared shingles from which documents are near duplicates.
SIMILAR = 80

#: Bytes from which a repeated string is a passage: about 50 short words.
PASSAGE_BYTES = 256


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the isolation forests."""
    stats = written(rule_forest.statistics(docs), "rules")
    forests = rule_forest.fit(stats, table(spark, sf_dir, "labels"))
    return docs.filter(rule_forest.keeps(F.col("text"), forests))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose sentences together are unlikely to be toxic."""
    model = toxicity_mil.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_mil.score_text(F.col("text"), model) < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates."""
    classes = minhash_hamming.near_duplicates(docs, percent=SIMILAR)
    # An id that names several texts goes only if none of them stands for its class.
    gone = classes.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once."""
    rows = suffix_buckets.remove_repeats(docs, min_bytes=PASSAGE_BYTES)
    text = F.when(F.col("text").isNotNull(), F.col("cut.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("cut.spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return swap_packing.pack(swap_packing.tokenize(docs, path, keep_ids=False))


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("minhash near duplicates", near_duplicates),
    ("suffix-array deduplication", repeated_strings),
    ("best-fit packing", packing),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
