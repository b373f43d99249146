"""Quality rules: isolation forests over rule statistics of documents.

``statistics`` counts words, symbols, repeated lines and repeated three-word windows of every
whole text. Two fixed rules (too few words, mostly repeated words) fail documents at once. For
the rest, random splits over ratios of the statistics isolate unusual documents after short
paths. Rules of one kind (symbols, repetition, shape of words) share a forest; each forest has
a threshold of its own, calibrated on labelled rows, and a document above any of them goes.

The trees grow from a bounded sample (``Limits.sample_rows`` rows in hash order, of which each
tree takes ``Limits.tree_rows``), as the method has it; statistics, scores and the calibration
cover all rows.

Defined cases: a null or empty text has no words and fails; labels that are null or belong to
no document calibrate nothing; without labelled rows of both kinds nothing but the fixed rules
rejects; without any sample row likewise; repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import hash_sample, keyed_text, slabs
from tracelake.llm.words import eights, name_spans, shingles, word_spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_symbol_words",
    "n_mark_words",
)

#: The ratios that share a forest.
FAMILIES = {
    "symbols": ("symbols_per_word", "symbols_per_char", "symbol_words"),
    "repetition": ("dup_lines", "repeat_words"),
    "shape": ("chars_per_word", "mark_words"),
}


@dataclass(frozen=True)
class Limits:
    """Size of the forest, bound of its sample, and the calibration's tolerance."""

    trees: int = 100
    tree_rows: int = 256
    sample_rows: int = 16_384
    #: So many rejected bad documents outweigh one rejected good one in the calibration.
    good_weight: int = 25
    #: Steps of the score between 0 and 1 that the calibration tells apart.
    steps: int = 4_096
    seed: int = 11


@dataclass(frozen=True)
class Forest:
    """Trees as arrays by node: feature (-1 in leaves), split, children, path length in leaves."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = 2.0


def count(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ``COUNTS`` of texts that lie end to end."""
    n = len(offsets) - 1
    start, end, first = word_spans(raw, offsets)
    eight = eights(raw)

    def tally(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    chars, symbols, letters = tally((raw & 0xC0) != 0x80), tally(_SYMBOL[raw]), tally(_LETTER[raw])
    words = np.diff(first)
    text = np.repeat(np.arange(n), words)
    word_chars = np.bincount(text, chars[end] - chars[start], n)
    symbol_words = np.bincount(text, symbols[end] > symbols[start], n)
    marks = np.bincount(text, letters[end] == letters[start], n)

    # Lines run from a text's begin or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(raw == 0x0A)
    begins = np.union1d(offsets[:-1], feeds + 1)
    begins = begins[begins < len(raw)]
    ends = np.append(begins[1:], len(raw))
    ends = ends - ((ends > begins) & (raw[ends - 1] == 0x0A) if len(begins) else 0)
    worded = np.searchsorted(start, ends) > np.searchsorted(start, begins)
    begins, ends = begins[worded], ends[worded]
    line_text = np.searchsorted(offsets, begins, "right") - 1
    line = name_spans(eight, begins, ends)
    order = np.lexsort((line, line_text))
    again = np.zeros(len(order), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])
    dup_lines = np.bincount(line_text[order], again, n)

    windows, bounds = shingles(name_spans(eight, start, end), first, 3)
    covered = np.zeros(len(start) + 1, np.int64)
    for k in np.flatnonzero(words >= 3).tolist():
        own = windows[bounds[k] : bounds[k + 1]]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            at = first[k] + np.flatnonzero(np.isin(own, twice))
            covered[at] += 1
            np.add.at(covered, at + 3, -1)
    repeated = np.bincount(text, np.cumsum(covered[:-1]) > 0, n)
    total_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
    columns = (
        words, word_chars, total_symbols, dup_lines, repeated,
        np.bincount(line_text, minlength=n), symbol_words, marks,
    )
    return [np.asarray(c).astype(np.int64) for c in columns]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts of each text, and ``base_failed``."""
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for begin, end, raw, offsets in slabs(batch):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, end - begin), *map(pa.array, count(raw, offsets))],
                    [id_col, *COUNTS],
                )

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.mapInArrow(run, schema).withColumn("base_failed", failed)


def ratios(columns: dict[str, np.ndarray], family: str) -> np.ndarray:
    """The inputs of a family's forest, one row per document."""
    c = {k: np.asarray(v, float) for k, v in columns.items()}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    found = {
        "symbols_per_word": c["n_symbols"] / words,
        "symbols_per_char": c["n_symbols"] / np.maximum(c["word_chars"], 1),
        "symbol_words": c["n_symbol_words"] / words,
        "dup_lines": c["n_dup_lines"] / lines,
        "repeat_words": c["n_repeat_words"] / words,
        "chars_per_word": c["word_chars"] / words,
        "mark_words": c["n_mark_words"] / words,
    }
    return np.stack([found[name] for name in FAMILIES[family]], axis=1)


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, limits: Limits) -> Forest:
    """Trees of random splits, each over its own rows of the sample."""
    rng = np.random.default_rng(limits.seed)
    size = min(limits.tree_rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    width = 1 << (depth + 1)
    feature = np.full((limits.trees, width), -1)
    split, path = np.zeros((limits.trees, width)), np.zeros((limits.trees, width))
    for t in range(limits.trees):
        todo = [(1, rng.permutation(len(x))[:size], 0)]
        while todo:
            node, rows, level = todo.pop()
            part = x[rows]
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0),) * 2
            usable = np.flatnonzero(high > low)
            if level == depth or not len(usable):
                path[t, node] = level + mean_path(len(rows))
                continue
            f = int(rng.choice(usable))
            s = rng.uniform(low[f], high[f])
            feature[t, node], split[t, node] = f, s
            less = part[:, f] <= s
            todo += [(2 * node, rows[less], level + 1), (2 * node + 1, rows[~less], level + 1)]
    child = np.arange(width)
    return Forest(feature, split, 2 * child, 2 * child + 1, path, max(mean_path(size), 1e-9))


def anomaly(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; shorter mean paths score higher."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, path in zip(forest.feature, forest.split, forest.path):
        node = np.ones(len(x), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            more = x[rows, np.maximum(f, 0)] > split[node]
            node = np.where(inner, np.where(more, forest.right[node], forest.left[node]), node)
        total += path[node]
    return np.exp2(-total / len(forest.path) / forest.norm)


def score(stats: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """``stats`` with an ``anomaly_`` column per family and ``kept``.

    A document is kept if no fixed rule fails and every anomaly is below its threshold.
    """
    kept = ~F.col("base_failed")
    for family, forest in forests.items():
        stats = stats.withColumn(f"anomaly_{family}", _anomaly(family, forest))
        kept = kept & (F.col(f"anomaly_{family}") < forest.threshold)
    return stats.withColumn("kept", kept)


def keeps(text: Column, forests: dict[str, Forest]) -> Column:
    """The verdict on each text, without a join with its statistics."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        out = [np.zeros(0, bool)]
        for _, _, raw, offsets in slabs(batch):
            counts = dict(zip(COUNTS, count(raw, offsets)))
            kept = (counts["n_words"] >= 50) & (100 * counts["n_repeat_words"] <= 50 * counts["n_words"])
            for family, forest in forests.items():
                kept &= anomaly(forest, ratios(counts, family)) < forest.threshold
            out.append(kept)
        return pa.array(np.concatenate(out))

    return run(text)


def _anomaly(family: str, forest: Forest) -> Column:
    @F.arrow_udf("double")
    def scored(*columns: pa.Array) -> pa.Array:
        counts = {k: np.asarray(v) for k, v in zip(COUNTS, columns)}
        return pa.array(anomaly(forest, ratios(counts, family)))

    return scored(*(F.col(c) for c in COUNTS))


def fit(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    limits: Limits = Limits(),
) -> dict[str, Forest]:
    """Grow each family's trees and calibrate its threshold; ``stats`` is read several times.

    Rows that the fixed rules fail neither grow trees nor count in the calibration.
    """
    passed = stats.filter(~F.col("base_failed") & F.col(id_col).isNotNull())
    sample = hash_sample(passed, limits.sample_rows, id_col).select(*COUNTS).toPandas()
    if not len(sample):
        return {}
    columns = {c: sample[c].to_numpy() for c in COUNTS}
    forests = {family: grow(ratios(columns, family), limits) for family in FAMILIES}
    known = labels.select(
        F.col(f"`{id_col}`").alias(id_col), F.col(f"`{label_col}`").cast("int").alias("label")
    ).filter("label IN (0, 1)")
    judged = score(passed.join(known, id_col), forests)
    for family, forest in forests.items():
        step = F.floor(F.col(f"anomaly_{family}") * limits.steps).alias("step")
        tally = np.zeros((2, limits.steps + 1), np.int64)
        for r in judged.groupBy(step, "label").count().collect():
            tally[r["label"], r["step"]] += r["count"]
        forests[family] = replace(forest, threshold=threshold(tally, limits))
    return forests


def threshold(tally: np.ndarray, limits: Limits) -> float:
    """Where the bad rows above most outweigh the good ones; 2 rejects nothing.

    Among equally good steps the middle one is taken, so that unseen rows on either side of
    an empty stretch fall to their own kind.
    """
    good, bad = (tally[k][::-1].cumsum()[::-1] for k in (1, 0))
    if not good[0]:
        return 2.0
    net = bad - limits.good_weight * good
    if net.max() <= 0:
        return 2.0
    best = np.flatnonzero(net == net.max())
    run = best[best - best[0] == np.arange(len(best))]  # the lowest stretch without gaps
    return float((run[0] + run[-1]) / 2 / limits.steps)
