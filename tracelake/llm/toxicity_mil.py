"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the words (and word beginnings) it holds; a document
is toxic unless all its sentences are clean, so the sentences combine by noisy-or. Training
sees document labels only and uses a bounded sample of the labelled rows
(``Limits.sample_rows`` in hash order) to choose features and to fit their weights. The fitted
model scores every document and locates the sentences responsible.

Words are runs of letters, lower-cased in A-Z; sentences end at ``. ! ?`` and line ends.

Defined cases: a null or empty text has no sentence and score 0; labels that are null or
belong to no document teach nothing; without labelled rows, or with one class only, the model
has no features and every sentence the same small probability; repeated rows are scored one
by one; documents with several labels teach each of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import hash_sample, keyed_text, slabs, written
from tracelake.llm.words import eights, mix, name_spans, per_text, word_spans

_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
#: Lengths, in bytes, of the word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6)
#: Slots of the filter that most words fail before they are looked up.
_FILTER_BITS = 20

_COUNTS = "feature long, toxic long, clean long"
_BAG = "id long, label int, n_sentences long, sentence array<int>, feature array<int>"


@dataclass(frozen=True)
class Limits:
    """Bounds of the training: rows of the sample, features, passes over the sample."""

    sample_rows: int = 40_000
    features: int = 8_192
    min_documents: int = 3
    passes: int = 400
    min_log_odds: float = 1.0
    l1: float = 3e-4


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def sentence_features(raw: np.ndarray, offsets: np.ndarray):
    """For each text's words: sentence number within the slab and feature hashes.

    Returns ``(first word of each text, sentence of each word, hashes by kind, starts, ends)``.
    """
    start, end, first = word_spans(raw, offsets, _LETTER)
    eight = eights(raw, lower=True)
    stops = np.cumsum(_STOP[raw], dtype=np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = stops[start] if len(start) else np.zeros(0, np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    kinds = [name_spans(eight, start, end)]
    for size in BEGINNINGS:
        short = np.minimum(end, start + size)
        kinds.append(mix(name_spans(eight, start, short) + _U(size)))
    return first, np.cumsum(fresh) - 1, kinds, start, end


def _count_features(batches):
    """How many toxic and clean documents of each batch hold each feature."""
    for batch in batches:
        labels = np.asarray(batch.column("label"))
        for begin, end, raw, offsets in slabs(batch):
            first, _, kinds, _, _ = sentence_features(raw, offsets)
            text = np.repeat(np.arange(end - begin), np.diff(first))
            order = {}
            for hashes in kinds:
                seen = np.unique(np.stack([text.astype(np.uint64), hashes]), axis=1) if len(text) else None
                if seen is not None:
                    order.setdefault("t", []).append(seen[0].astype(np.int64))
                    order.setdefault("h", []).append(seen[1])
            if not order:
                continue
            texts, hashes = np.concatenate(order["t"]), np.concatenate(order["h"])
            found, at = np.unique(hashes, return_inverse=True)
            toxic = np.bincount(at, labels[begin + texts] == 1, len(found))
            total = np.bincount(at, minlength=len(found))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.view(np.int64)),
                    pa.array(toxic.astype(np.int64)),
                    pa.array(total.astype(np.int64) - toxic.astype(np.int64)),
                ],
                ["feature", "toxic", "clean"],
            )


class _Vocabulary:
    """Sorted features with a filter in front."""

    def __init__(self, features: np.ndarray):
        self.features = features
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(features >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known features and their numbers."""
        maybe = np.flatnonzero(self.filter[(hashes >> _U(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        number = np.minimum(np.searchsorted(self.features, hashes[maybe]), len(self.features) - 1)
        hit = self.features[number] == hashes[maybe]
        return maybe[hit], number[hit]

    def hits(self, raw: np.ndarray, offsets: np.ndarray):
        """Distinct ``(sentence, feature)`` of the slab, and each text's first sentence."""
        first, sentence, kinds, start, end = sentence_features(raw, offsets)
        found = [self.find(hashes) for hashes in kinds]
        words = np.concatenate([w for w, _ in found])
        numbers = np.concatenate([n for _, n in found])
        pairs = np.unique(sentence[words] * len(self.features) + numbers) if len(words) else words
        bounds = np.append(sentence, sentence[-1] + 1 if len(sentence) else 0)[first]
        size = max(1, len(self.features))
        return pairs // size, pairs % size, bounds, (first, sentence, start, end)


def _bags(features: np.ndarray):
    def run(batches):
        vocabulary = _Vocabulary(features)
        for batch in batches:
            ids, labels = np.asarray(batch.column("id")), np.asarray(batch.column("label"))
            for begin, end, raw, offsets in slabs(batch):
                sentence, feature, bounds, _ = vocabulary.hits(raw, offsets)
                cut = np.searchsorted(sentence, bounds)
                own = sentence - np.repeat(bounds[:-1], np.diff(cut))
                lists = [
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x.astype(np.int32)))
                    for x in (own, feature)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[begin:end]),
                        pa.array(labels[begin:end].astype(np.int32)),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        *lists,
                    ],
                    ["id", "label", "n_sentences", "sentence", "feature"],
                )

    return run


def fit_weights(bags, n_features: int, limits: Limits) -> tuple[np.ndarray, float]:
    """Weights that maximize the noisy-or likelihood of the documents' labels (Adam)."""
    y = np.array([b["label"] for b in bags], float)
    sentences = np.array([b["n_sentences"] for b in bags], float)
    doc, feature, instance = [], [], []
    n_instances = 0
    for k, bag in enumerate(bags):
        own, at = np.unique(np.asarray(bag["sentence"], np.int64), return_inverse=True)
        doc.append(np.full(len(own), k))
        instance.append(at + n_instances)
        feature.append(np.asarray(bag["feature"], np.int64))
        n_instances += len(own)
    doc, instance, feature = (np.concatenate(x).astype(np.int64) for x in (doc, instance, feature))
    plain = sentences - np.bincount(doc, minlength=len(y))
    theta = np.zeros(n_features + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, limits.passes + 1):
        z = theta[-1] + np.bincount(instance, theta[feature], n_instances)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        clean = -np.logaddexp(0, z)
        total = np.bincount(doc, clean, len(y)) - plain * np.logaddexp(0, theta[-1])
        total = np.minimum(total, -1e-9)
        factor = np.where(y == 1, -np.exp(total) / -np.expm1(total), 1.0)
        gz = p * factor[doc]
        grad = np.zeros_like(theta)
        grad[:-1] = np.bincount(feature, gz[instance], n_features) / len(y) + limits.l1 * np.sign(theta[:-1])
        grad[-1] = (gz.sum() + (plain * p0 * factor).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    teaches: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    limits: Limits = Limits(),
) -> Model:
    """Learn from labelled documents, only those for which ``teaches`` (over ``id``) holds."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)")
    if teaches is not None:
        known = known.filter(teaches)
    # Labels of absent documents teach nothing, so they take no place of the sample.
    known = known.join(docs.select(F.col(f"`{id_col}`").alias("id")), "id", "left_semi")
    # The sample is bounded by a parameter, so it may be broadcast and no other text moves.
    sample = hash_sample(known, limits.sample_rows, "id", "label")
    rows = keyed_text(docs, id_col, text_col).join(F.broadcast(sample), "id")
    taught = written(rows.select(F.col("id").cast("long").alias("id"), "label", "text"), "taught")
    sizes = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -9.0)
    counts = (
        taught.mapInArrow(_count_features, _COUNTS)
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= limits.min_documents)
    )
    # A cautious estimate of the log odds that a feature adds: lower by 1.64 standard errors.
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / b) - F.lit(float(np.log(sizes[1] / sizes[0]))) - 1.64 * F.sqrt(1 / a + 1 / b)
    chosen = counts.withColumn("odds", odds).filter(F.col("odds") > limits.min_log_odds)
    chosen = chosen.orderBy(F.col("odds").desc(), "feature").limit(limits.features)
    features = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64).view(np.uint64))
    if not len(features):
        return Model(features, np.zeros(0), -9.0)
    weights, bias = fit_weights(taught.mapInArrow(_bags(features), _BAG).collect(), len(features), limits)
    return Model(features, weights, bias)


def _sentence_scores(model: Model, vocabulary: _Vocabulary, raw, offsets):
    """Score of each text, and the slab's sentences with features and their scores."""
    sentence, feature, bounds, words = vocabulary.hits(raw, offsets)
    own, at = np.unique(sentence, return_inverse=True)
    z = model.bias + np.bincount(at, model.weights[feature] if len(feature) else None, len(own))
    clean = -np.logaddexp(0, z)
    cut = np.searchsorted(own, bounds)
    listed = per_text(np.add, clean, cut, 0.0)
    rest = np.diff(bounds) - np.diff(cut)
    score = -np.expm1(listed - rest * np.logaddexp(0, model.bias))
    return score, own, z, bounds, cut, words


def score_text(text: Column, model: Model) -> Column:
    """The score of each text as a column."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        vocabulary, out = _Vocabulary(model.features), [np.zeros(0)]
        for _, _, raw, offsets in slabs(pa.RecordBatch.from_arrays([texts], ["text"])):
            out.append(np.clip(_sentence_scores(model, vocabulary, raw, offsets)[0], 0.0, 1.0))
        return pa.array(np.concatenate(out))

    return run(text)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5
) -> DataFrame:
    """Per document: ``score, n_sentences`` and the byte ranges of the offending sentences.

    ``offending`` lists ``begin, end, score`` of sentences whose own score is ``at_least``.
    """
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    spans = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        vocabulary = _Vocabulary(model.features)
        for batch in batches:
            for begin, end, raw, offsets in slabs(batch):
                total, own, z, bounds, cut, (first, sentence, start, stop) = _sentence_scores(
                    model, vocabulary, raw, offsets
                )
                p = 1 / (1 + np.exp(-z))
                bad = np.flatnonzero(p >= at_least)
                left = np.searchsorted(sentence, own[bad])
                right = np.searchsorted(sentence, own[bad], "right") - 1
                text = np.searchsorted(bounds, own[bad], "right") - 1
                found = pa.StructArray.from_arrays(
                    [
                        pa.array(start[left] - offsets[text]),
                        pa.array(stop[right] - offsets[text]),
                        pa.array(p[bad]),
                    ],
                    fields=list(spans),
                )
                lists = np.searchsorted(bad, cut).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(begin, end - begin),
                        pa.array(np.clip(total, 0.0, 1.0)),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(lists), found),
                    ],
                    [id_col, "score", "n_sentences", "offending"],
                )

    schema = (
        f"`{id_col}` {kind}, score double, n_sentences long, "
        "offending array<struct<begin:bigint,end:bigint,score:double>>"
    )
    return rows.mapInArrow(run, schema)
