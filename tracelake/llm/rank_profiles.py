"""Language of a text by rank-order profiles of character n-grams.

A profile lists n-grams by falling frequency. Each language's profile comes from all its teaching
documents; a document's most frequent n-grams are compared with it by the out-of-place distance:
the differences of ranks, and ``Limits.profile`` for an n-gram that the language's profile lacks.
The language of the smallest distance wins, the smallest name among equals. N-grams of one
frequency share the mean of their ranks, so short texts, whose n-grams mostly occur once, are
judged by how frequent these are in a language.

N-grams have one to three characters of lower-cased words (letters and combining marks), with one
blank on either side of a word. Whole texts are counted, long ones in pieces of bounded size.

The score is the runner-up's share of the two smallest distances: 0.5 for a tie, 1 if the text is
ranked just like its language, and 1 if only one language is known.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
nothing was learnt; rows with a null language or text teach nothing; bytes that are not UTF-8 are
no letters; repeated rows are counted and judged one by one; profiles of a language with fewer
n-grams are shorter. Every task holds the profiles of all languages, a fixed size each.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a character in an n-gram's number; 0 is none, 1 a blank, others a code point plus 1.
_BITS = 21
_BLANK = 1
#: Characters that are counted at once.
_PIECE = 1 << 16
#: Different n-grams that a task collects before it hands them on.
_HELD = 1 << 20

UNKNOWN = "und"
_COUNTS = "lang string, gram long, n long"


@dataclass(frozen=True)
class Limits:
    """N-grams of a language's profile, and the most frequent ones that are taken of a document."""

    profile: int = 1_000
    document: int = 1_000


@dataclass(frozen=True)
class Profiles:
    """``grams`` ascending, each with a language's number and its rank there."""

    languages: tuple[str, ...]
    grams: np.ndarray
    language: np.ndarray
    rank: np.ndarray
    limits: Limits


@cache
def _kinds() -> np.ndarray:
    """For every code point: 2 for letters, 1 for combining marks, 0 for others."""
    kind = {"L": 2, "M": 1}
    return np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def characters(text: bytes | None) -> np.ndarray:
    """Words as code points plus 1 with single blanks around them; empty without a letter."""
    if not text:
        return np.zeros(0, np.int64)
    lower = text.decode("utf-8", "ignore").lower()
    points = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kinds = _kinds()[points]
    if not (kinds == 2).any():
        return np.zeros(0, np.int64)
    padded = np.zeros(len(points) + 2, np.int64)
    padded[1:-1] = np.where(kinds > 0, points, -1)
    padded[[0, -1]] = -1
    repeated = np.zeros(len(padded), bool)
    repeated[1:] = (padded[1:] < 0) & (padded[:-1] < 0)
    out = padded[~repeated] + 1
    out[out == 0] = _BLANK
    return out


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def count_grams(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of ``characters`` and how often they occur."""
    grams, counts = [], []
    for begin in range(0, len(text), _PIECE):
        a = text[begin : begin + _PIECE + 2]
        own = min(_PIECE, len(text) - begin)
        solid = a != _BLANK
        two = (a[:-1] | a[1:] << _BITS)[:own]
        three = (a[:-2] | a[1:-1] << _BITS | a[2:] << 2 * _BITS)[:own][solid[1:-1][:own]]
        found, n = np.unique(np.concatenate([a[:own][solid[:own]], two, three]), return_counts=True)
        grams.append(found)
        counts.append(n)
    if len(grams) == 1:
        return grams[0], counts[0]
    return _merged(grams, counts) if grams else (text, text)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent n-grams and their ranks from 0; equal counts share the mean rank."""
    if len(grams) > 4 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= least], counts[counts >= least]
    order = np.lexsort((grams, -counts))[:most]
    falling = counts[order]
    fresh = np.flatnonzero(np.concatenate([[True], falling[1:] != falling[:-1]])) if len(falling) else order
    ends = np.append(fresh[1:], len(falling))
    return grams[order], np.repeat((fresh + ends - 1) / 2, ends - fresh)


def _count_languages(batches):
    """Partial counts of each language's n-grams."""
    held: dict[str, list] = {}
    size = 0

    def emit():
        for lang, parts in held.items():
            found, n = _merged(*zip(*parts))
            for k in range(0, len(found), 10_000):
                some = slice(k, k + 10_000)
                arrays = [pa.array([lang] * len(found[some])), pa.array(found[some]), pa.array(n[some])]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            grams, counts = count_grams(characters(text.as_py()))
            if not len(grams):
                continue
            held.setdefault(lang, []).append((grams, counts))
            size += len(grams)
            if size > _HELD:
                held.update({k: [_merged(*zip(*parts))] for k, parts in held.items()})
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _HELD // 2:
                    yield from emit()
                    size = 0
    yield from emit()


def learn(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", limits: Limits = Limits()) -> Profiles:
    """The profile of each language of ``rows``."""
    taught = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counts = taught.filter("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_count_languages, _COUNTS)
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = counts.withColumn("place", place).filter(F.col("place") <= limits.profile).toArrow()
    languages = tuple(sorted(set(top.column("lang").to_pylist())))
    parts = []
    for k, lang in enumerate(languages):
        own = top.filter(pa.compute.equal(top.column("lang"), lang))
        grams, ranks = ranked(np.asarray(own.column("gram")), np.asarray(own.column("n")), limits.profile)
        parts.append((grams, np.full(len(grams), k), ranks))
    grams, language, rank = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.argsort(grams, kind="stable")
    return Profiles(languages, grams[order], language[order], rank[order], limits)


def distances(text: np.ndarray, profiles: Profiles) -> np.ndarray:
    """Out-of-place distance of a text's ``characters`` to each language."""
    grams, ranks = ranked(*count_grams(text), profiles.limits.document)
    low, high = np.searchsorted(profiles.grams, grams), np.searchsorted(profiles.grams, grams, "right")
    run = high - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(run)[:-1]]), run) + np.arange(run.sum())
    missing = profiles.limits.profile
    near = np.minimum(np.abs(np.repeat(ranks, run) - profiles.rank[at]), missing) - missing
    return len(grams) * float(missing) + np.bincount(profiles.language[at].astype(np.int64), near, len(profiles.languages))


def identify(text: Column, profiles: Profiles) -> Column:
    """``lang_pred, score`` of each text."""

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for value in texts.cast(pa.large_binary()):
            chars = characters(value.as_py())
            if not len(chars) or not profiles.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            distance = distances(chars, profiles)
            best = int(np.argmin(distance))
            second = np.min(np.delete(distance, best)) if len(distance) > 1 else None
            total = distance[best] + second if second is not None else None
            names.append(profiles.languages[best])
            scores.append(1.0 if total is None else 0.5 if not total else float(second / total))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return run(text)
