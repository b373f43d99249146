"""Vectorized words and hashes over many UTF-8 texts laid end to end.

``name_spans`` tells spans of any length apart. ``prefix_hashes`` and ``span_hash`` are a rolling hash:
linear, so made for windows at every place and not for long spans, where texts built to that end agree.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = _U(0x9E3779B97F4A7C15)
BASE_INV = _U(pow(int(BASE), -1, 1 << 64))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GRAM = _random.integers(1, 1 << 63, 16, dtype=np.uint64) * _U(2) + _U(1)
#: Masks of the first 0 .. 8 of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers = {BASE: np.ones(1, np.uint64), BASE_INV: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. n - 1`` modulo 2**64, kept per process and grown by doubling."""
    p = _powers[base]
    while len(p) < n:
        p = np.concatenate([p, p * (p[-1:] * base)])
    _powers[base] = p
    return p[:n]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` derives the hash of any span."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(BASE, len(raw)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes ``start:end``, equal for equal bytes anywhere."""
    return mix((prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start] + (end - start).astype(np.uint64))


def eights(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """The eight bytes from every place as one number; zeros follow the last byte."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = _FOLD[raw] if lower else raw
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def name_spans(eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes ``start:end``, equal for equal bytes anywhere.

    ``eight`` comes from ``eights``. Every eight bytes are mixed with their number in the span before they
    are added up, so no pattern of bytes cancels out.
    """
    size = (end - start).astype(np.int64)
    pieces = (size + 7) >> 3
    bounds = np.concatenate([[0], np.cumsum(pieces)])
    number = np.arange(bounds[-1]) - np.repeat(bounds[:-1], pieces)
    left = np.repeat(size, pieces) - 8 * number
    value = eight[np.repeat(start, pieces) + 8 * number] & _FIRST[np.minimum(left, 8)]
    value = mix(value ^ mix(number.astype(np.uint64) * BASE + _U(1)))
    return mix(per_text(np.add, value, bounds, 0) + mix(size.astype(np.uint64)))


def word_spans(
    raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word and each text's first word number.

    ``inside`` tells the bytes of words, as shipped those of ``[^\\x20\\x09-\\x0D]+``.
    """
    solid = inside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    opens = solid & edge[:-1]
    opens[1:] |= solid[1:] & ~solid[:-1]
    closes = solid & edge[1:]
    closes[:-1] |= solid[:-1] & ~solid[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words and each text's first run number.

    A text of fewer words gives its whole sequence as one, a text without words none.
    """
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], runs)
    width = np.repeat(np.minimum(count, size), runs)
    total = width.astype(np.uint64)
    for k in range(size):
        word = hashes[np.minimum(at + k, len(hashes) - 1)] if len(hashes) else hashes
        total = total + np.where(k < width, word, _U(0)) * _GRAM[k]
    return mix(total), bounds


def per_text(reduce, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``reduce.reduceat`` over each text's values, ``empty`` where a text has none."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = reduce.reduceat(values, bounds[:-1][full])
    return out
