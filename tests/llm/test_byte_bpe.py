import hashlib

import public_tokenizers
import regex
from pyspark.sql import functions as F

from tracelake.llm import byte_bpe
from tracelake.llm.queries import op10_tiktoken_bpe

from .conftest import SF, odd_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def merged(piece: bytes, ranks):
    """Plain byte pair merging: the pair of the lowest rank first."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def plain(text, seen={}):
    out, ranks = [], byte_bpe.ranks(PATH)
    for match in regex.findall(public_tokenizers.PATTERN, text or ""):
        if match not in seen:
            seen[match] = merged(match.encode(), ranks)
        out += seen[match]
    return out


def test_query_equals_plain_merging(spark, texts):
    rows = op10_tiktoken_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_cuts_change_no_id():
    text = "don't  stop \n\n x's\t 12a b c   d\x1c e " * 30 + "   "
    whole = byte_bpe.encoding(PATH, public_tokenizers.PATTERN).encode_ordinary(text)
    for chunk in (1, 3, 7, 50):
        parts = byte_bpe.pieces(text, chunk)
        assert "".join(parts) == text
        got = [i for p in parts for i in byte_bpe.encoding(PATH, public_tokenizers.PATTERN).encode_ordinary(p)]
        assert got == whole


def test_odd_rows(spark, odd, empty):
    got = byte_bpe.encode_documents(odd, PATH).withColumn("raw", byte_bpe.decode(F.col("ids"), PATH))
    want = sorted((str(r[0]), (r[1] or "").encode()) for r in odd_rows())
    assert sorted((str(r["doc_id"]), bytes(r["raw"])) for r in got.collect()) == want
    assert byte_bpe.encode_documents(empty, PATH).count() == 0
    lists = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [bytes(r[0]) for r in lists.select(byte_bpe.decode(F.col("ids"), PATH)).collect()] == [b"", b""]
