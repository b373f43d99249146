"""Packing documents into sequences: best fit, then swap-based local search.

``tokenize`` turns texts into pieces of at most ``capacity`` ids; only longer documents are
cut, the first piece taking what does not fill a whole one. ``pack`` deals the pieces by
hash of their place to groups of bounded size and packs each group alone: best fit in decreasing order,
then moves that carry documents from emptier to fuller bins (a move, one for one, two for
one, one for two). Every move increases the sum of squared fills, so the search ends; it
stops early at the group's lower bound.

Defined cases: a null or empty text is the end mark alone; a null or negative length takes no
room; a length above the capacity fails; repeated rows are packed one by one; ties are broken
by row order within the group; ``sequence_id`` and ``offset`` replace columns of these names.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import keyed_text, slabs, written

CAPACITY = 2048
#: Rows that are packed together; the waste is below one bin in as many.
GROUP_ROWS = 8192
#: Words that a worker remembers before it starts afresh, also between tasks: about 40 MB.
CACHE_WORDS = 1 << 18
#: Longer words are encoded again each time.
CACHE_BYTES = 40
_GROUP = "__group"
_SLAB = 1 << 22


@lru_cache(maxsize=2)
def _merges(path: str) -> tuple[tiktoken.Encoding, dict[bytes, bytes]]:
    """The vocabulary of a byte-level tokenizer file and the words encoded so far, ids packed.

    In such a file a token's id is also the order of its merge, so the merges can run in
    the faster library; ids are those of the ``tokenizers`` library.
    """
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(other)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if set(t) <= byte_of.keys()}
    special = {t for t in vocabulary if t.startswith("<|")}
    ranks = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in special}
    pattern = public_tokenizers.PATTERN
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), {}


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where words begin, white space before a word included in it.

    Where a space or newline follows a non-space, the tokenizer's pattern always starts
    anew. Texts in letters of three and more bytes are only cut after ASCII letters and marks.
    """
    solid = (raw > 0x20) & (raw < 0x7F)
    letter = np.zeros(len(raw), bool)
    letter[1:] = (raw[1:] >= 0x80) & (raw[1:] < 0xC0) & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)
    cut = np.zeros(len(raw) + 1, bool)
    cut[1:-1] = (solid | letter)[:-1] & ((raw[1:] == 0x20) | (raw[1:] == 0x0A))
    cut[offsets] = True
    return np.flatnonzero(cut)


def encode(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts that lie end to end, and each text's first place among them.

    Every distinct word is encoded once and its ids are copied to its places.
    """
    bpe, known = _merges(path)
    bounds = word_bounds(raw, offsets)
    if len(bounds) < 2:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]
    ).dictionary_encode()
    coded = []
    for word in words.dictionary.to_pylist():
        ids = known.get(word)
        if ids is None:
            ids = array("I", bpe.encode_ordinary(word.decode("utf-8", "replace"))).tobytes()
            if len(word) <= CACHE_BYTES:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                known[word] = ids
        coded.append(ids)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
    flat = np.frombuffer(b"".join(coded), np.uint32).astype(np.int64)
    at = np.asarray(words.indices)
    each = sizes[at]
    ends = np.concatenate([[0], np.cumsum(each)])
    first = (np.cumsum(sizes) - sizes)[at]
    ids = flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], each)]
    return ids, ends[np.searchsorted(bounds, offsets)]


def tokenize(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 0,
    keep_ids: bool = True,
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` and, if kept, the ``ids`` of each piece."""
    rows = keyed_text(docs, id_col, text_col)
    fields = [
        T.StructField(id_col, rows.schema["id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        for batch in batches:
            for begin, end, raw, offsets in slabs(batch, limit=_SLAB):
                source, piece, start, length, crc, kept = [], [], [], [], [], []
                coded, bounds = encode(raw, offsets, path)
                coded = coded.astype("<u4")
                for row in range(end - begin):
                    ids = np.append(coded[bounds[row] : bounds[row + 1]], np.uint32(end_id))
                    first = (len(ids) - 1) % capacity + 1
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        source.append(begin + row)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                        if keep_ids:
                            kept.append(ids[a:b].astype(np.int32))
                columns = [
                    batch.column("id").take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ]
                if keep_ids:
                    columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of each bin: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: some bin has room r
    for row in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[row])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(row)
        else:
            room, b = capacity, len(bins)
            bins.append([row])
        room -= size
        by_room[room].append(b)
        rooms |= 1 << room
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by the total, or by the long ones that cannot share."""
    best = math.ceil(int(lengths.sum()) / capacity)
    order = np.sort(lengths)[::-1]
    total = np.concatenate([[0], np.cumsum(order)])
    half = int(np.searchsorted(-order, -(capacity / 2), "left"))  # longer than half a bin
    for k in np.unique(order[order <= capacity // 2]):
        big = int(np.searchsorted(-order, -(capacity - int(k)), "left"))  # longer than capacity - k
        last = int(np.searchsorted(-order, -int(k), "right"))  # at least k
        room = (half - big) * capacity - int(total[half] - total[big])
        best = max(best, half + max(0, math.ceil((int(total[last] - total[half]) - room) / capacity)))
    return best


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different sums of two of a bin's documents, ascending, with the places of two that give each."""
    one, two = np.triu_indices(len(sizes), 1)
    sums, at = np.unique(sizes[one] + sizes[two], return_index=True)
    return sums, one[at], two[at]


class _Search:
    """Bins of one group with the moves between them.

    Only sums of sizes matter to a move, and a bin has at most as many as it has tokens. So all
    documents and pairs of a source are looked up at once for every document or pair of all other bins:
    the best partner is the largest sum that the other bin's room still takes.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.size, self.capacity = lengths, capacity
        self.bins = bins
        self.bin = np.empty(len(lengths), np.int64)
        for b, rows in enumerate(bins):
            self.bin[rows] = b
        self.room = np.array([capacity - int(lengths[rows].sum()) for rows in bins])
        self.pairs: list[tuple | None] = [None] * len(bins)
        self.all_pairs: tuple | None = None

    def shift(self, out: list[int], target: int, back: list[int]) -> None:
        source = int(self.bin[out[0]])
        for rows, a, b in ((out, source, target), (back, target, source)):
            for row in rows:
                self.bins[a].remove(row)
                self.bins[b].append(row)
                self.bin[row] = b
        gain = int(self.size[out].sum() - self.size[back].sum())
        self.room[source] += gain
        self.room[target] -= gain
        self.pairs[source] = self.pairs[target] = self.all_pairs = None

    def pairs_of(self, b: int) -> tuple:
        if self.pairs[b] is None:
            self.pairs[b] = _pairs(self.size[self.bins[b]])
        return self.pairs[b]

    def every_pair(self) -> tuple:
        """Sums of the pairs of all bins, their bins and the two places in them."""
        if self.all_pairs is None:
            found = [self.pairs_of(b) for b in range(len(self.bins))]
            home = np.repeat(np.arange(len(self.bins)), [len(p[0]) for p in found])
            self.all_pairs = (*(np.concatenate(x) for x in zip(*found)), home)
        return self.all_pairs

    def improve(self, source: int) -> bool:
        """The first kind of move that carries tokens from ``source`` to a fuller bin, the most of them."""
        mine = sorted(self.bins[source], key=lambda r: -self.size[r])
        open_ = (self.room > 0) & (self.room <= self.room[source])
        open_[source] = False
        if not open_.any():
            return False
        targets = np.flatnonzero(open_)
        rooms = self.room[targets]
        for row in mine:  # a move, to the bin that it fills best
            fits = np.flatnonzero(rooms >= self.size[row])
            if len(fits):
                self.shift([row], int(targets[fits[np.argmin(rooms[fits])]]), [])
                return True
        own = np.array(mine)
        singles, at = np.unique(self.size[own], return_index=True)
        sums, one, two = self.pairs_of(source)
        place = np.array(self.bins[source])
        # One for one, two for one: the largest sum of mine that each of their documents makes room for.
        theirs = np.flatnonzero(open_[self.bin])
        sizes, room = self.size[theirs], self.room[self.bin[theirs]]
        best, move = 0, None
        for values, docs in ((singles, own[at][:, None]), (sums, np.stack([place[one], place[two]], 1))):
            k, gain = self._largest(values, sizes, room)
            if k is not None and gain[k] > best:
                best = int(gain[k])
                mine_at = np.searchsorted(values, sizes[k] + gain[k])
                move = (docs[mine_at].tolist(), [int(theirs[k])])
        if move is None:  # one for two
            sums, one, two, home = self.every_pair()
            use = np.flatnonzero(open_[home])
            k, gain = self._largest(singles, sums[use], self.room[home[use]])
            if k is None:
                return False
            their_bin = self.bins[int(home[use[k]])]
            mine_at = np.searchsorted(singles, sums[use[k]] + gain[k])
            move = ([int(own[at][mine_at])], [their_bin[int(one[use[k]])], their_bin[int(two[use[k]])]])
        self.shift(move[0], int(self.bin[move[1][0]]), move[1])
        return True

    @staticmethod
    def _largest(values: np.ndarray, sizes: np.ndarray, room: np.ndarray):
        """For every size the gain of the largest value that fits in its place; where it is the most."""
        if not len(values) or not len(sizes):
            return None, None
        at = np.searchsorted(values, sizes + room, "right") - 1
        gain = np.where(at >= 0, values[np.maximum(at, 0)] - sizes, 0)
        k = int(gain.argmax())
        return (k, gain) if gain[k] > 0 else (None, None)

    def run(self, bound: int) -> None:
        """Try bins as sources, the emptiest first, until none has a move or the bound is met.

        Every move raises the sum of squared fills, so the search ends.
        """
        used, stuck = sum(map(bool, self.bins)), 0
        while used > bound:
            filled = np.flatnonzero(self.room < self.capacity)
            if stuck >= len(filled):
                break
            order = filled[np.argsort(-self.room[filled], kind="stable")]
            source = int(order[stuck])
            if self.improve(source):
                used -= not self.bins[source]
                stuck = 0 if not self.bins[source] else stuck
            else:
                stuck += 1


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every row of one group."""
    if len(lengths) and lengths.max() > capacity:
        raise ValueError(f"a piece of {lengths.max()} tokens is longer than {capacity}")
    search = _Search(lengths, best_fit(lengths, capacity), capacity)
    search.run(lower_bound(lengths, capacity))
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, rows in enumerate(filter(None, search.bins)):
        rows = sorted(rows)
        place[rows] = number
        offset[rows] = np.concatenate([[0], np.cumsum(lengths[rows])[:-1]])
    return place, offset


def pack(
    pieces: DataFrame,
    length_col: str = "length",
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` is written once to the shared folder; rows are dealt by their place in that
    table, so that equal rows spread over the groups and a repeated task deals them alike.
    """
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_rows))
    place = F.xxhash64(F.monotonically_increasing_id())
    dealt = pieces.withColumn(_GROUP, F.pmod(place, F.lit(groups)))
    schema = T.StructType(
        [
            *pieces.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in sortable])
        lengths = np.asarray(table.column(length_col).cast(pa.int64()).fill_null(0))
        place, offset = pack_group(np.maximum(lengths, 0), capacity)
        group = table.column(_GROUP)[0].as_py()
        return (
            table.drop_columns([_GROUP])
            .append_column("sequence_id", pa.array(place + (group << 32)))
            .append_column("offset", pa.array(offset))
        )

    sortable = [f.name for f in pieces.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    return dealt.groupBy(_GROUP).applyInArrow(run, schema)
