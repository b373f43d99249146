import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import swap_packing as packing
from tracelake.llm.queries import op9_swap_packing

from .conftest import SF, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return tokenizer


def plain(text, capacity=2048):
    """Pieces by the tokenizers library, cut from the end."""
    ids = library().encode(text or "", add_special_tokens=False).ids + [0]
    cuts = sorted({0, *range(len(ids), 0, -capacity)})
    return [(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:])]


def check_layout(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query(spark, texts):
    rows = op9_swap_packing(spark, SF).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert r["piece"] == len(got[r["doc_id"]])
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    assert got == {i: plain(t) for i, t in texts.items()}
    assert check_layout(rows) <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 1


def test_words_joined_equal_the_library():
    odd = ["don't  stop \n\n x's\t 12a b\xa0 c 　 d\x1c e\x85 \n ", " ", "", "日本 語\n です  x", "a" * 99 + " <|endoftext|>"]
    rng = random.Random(3)
    odd += ["".join(rng.choice(" \n\t\r\x1c\xa0 　ab1'é,日🙂s") for _ in range(200)) for _ in range(300)]
    raw = [t.encode() for t in odd]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, bounds = packing.encode(np.frombuffer(b"".join(raw), np.uint8), offsets, PATH)
    for k, text in enumerate(odd):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library().encode(text, add_special_tokens=False).ids


def test_search_mends_a_poor_start():
    rng = np.random.default_rng(1)
    saved = 0
    for _ in range(30):
        sizes = rng.integers(10, 70, 60)
        bins = [[i] for i in range(60)]
        search = packing._Search(sizes, bins, 100)
        before = (search.room != 100).sum()
        square = ((100 - search.room) ** 2).sum()
        bound = packing.lower_bound(sizes, 100)
        search.run(bound)
        used = sum(map(bool, search.bins))
        assert sorted(r for b in search.bins for r in b) == list(range(60))
        assert all(sizes[b].sum() <= 100 for b in search.bins)
        assert ((100 - search.room) ** 2).sum() >= square
        assert bound <= used <= bound + 3
        saved += before - used
    assert saved > 0


@pytest.mark.parametrize("sizes,out,back", [([50, 45, 40], [0], [2]), ([30, 24, 50, 45], [0, 1], [2]), ([60, 25, 30, 40], [0], [1, 2])])
def test_kinds_of_swaps(sizes, out, back):
    """One for one, two for one and one for two, where nothing can simply move."""
    bins = [out, [i for i in range(len(sizes)) if i not in out]]
    search = packing._Search(np.array(sizes), [list(b) for b in bins], 100)
    assert search.improve(0)
    assert sorted(search.bins[0]) == back


def test_odd_rows(spark, odd, empty):
    pieces = packing.tokenize(odd.withColumnRenamed("ids", "offset"), PATH)
    rows = packing.pack(pieces, group_rows=7).collect()
    want = sorted(p for _, t, *_ in odd_rows() for p in plain(t))
    assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    check_layout(rows)
    assert packing.pack(packing.tokenize(empty, PATH)).count() == 0
    lengths = spark.createDataFrame([(None,), (-1,), (2048,), (5,)], "length long")
    assert packing.pack(lengths).count() == 4
    equal = packing.pack(spark.range(200).selectExpr("100L AS length"), group_rows=20).collect()
    groups = Counter(r["sequence_id"] >> 32 for r in equal)
    assert len(equal) == 200 and len(groups) > 5 and max(groups.values()) < 60
    with pytest.raises(Exception, match="longer"):
        packing.pack(lengths.selectExpr("length + 1 AS length")).collect()


def test_search_of_all_bins_beats_best_fit():
    """Pieces between a seventh and a half of a bin, where best fit is far from the bound."""
    lengths = np.random.default_rng(0).integers(300, 1000, 2_048)
    place, offset = packing.pack_group(lengths)
    used = place.max() + 1
    assert used <= len(packing.best_fit(lengths, 2048)) - 4 and used >= packing.lower_bound(lengths, 2048)
    assert (np.bincount(place, lengths) <= 2048).all() and len(set(place.tolist())) == used
    for b in range(used):
        rows = np.flatnonzero(place == b)
        rows = rows[np.argsort(offset[rows])]
        assert offset[rows].tolist() == [0, *np.cumsum(lengths[rows])[:-1].tolist()]


def test_moves_of_every_kind_raise_the_squared_fill():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = rng.integers(1, 60, 30)
        search = packing._Search(lengths, [[k] for k in range(30)], 100)
        fill = lambda: int(((100 - search.room) ** 2).sum())
        for source in rng.integers(0, 30, 200).tolist():
            before = fill()
            if search.bins[source] and search.improve(source):
                assert fill() > before
        assert sorted(r for rows in search.bins for r in rows) == list(range(30)) and (search.room >= 0).all()
        assert all(search.room[b] == 100 - lengths[rows].sum() for b, rows in enumerate(search.bins))


def test_few_words_are_remembered(monkeypatch):
    """A worker keeps no more words than it may, also within one call."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    packing._merges.cache_clear()
    known = packing._merges(PATH)[1]
    text = " ".join(f"w{k % 700}x" for k in range(2_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, _ = packing.encode(raw, np.array([0, len(raw)]), PATH)
    assert ids.tolist() == library().encode(text, add_special_tokens=False).ids
    assert 0 < len(known) <= 50
