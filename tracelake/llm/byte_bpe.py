"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are pre-split where the split pattern starts a new match whatever follows: no
alternative of the pattern runs from a non-space into white space, so each place where a
space or newline follows a non-space begins a match. Pieces are encoded apart and their ids
joined, which bounds the library's working memory without changing an id.

Defined cases: null text is empty; an empty text has no ids and decodes to no bytes; null
ids decode to no bytes; a stretch without any boundary is encoded in one piece; unknown ids
fail; rows that share an id are encoded apart.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import keyed_text

#: Characters after which a long text is cut at the next boundary.
CHUNK_CHARS = 1 << 16
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        path, pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}
    )


@lru_cache(maxsize=4)
def token_bytes(path: str) -> pa.Array:
    """The bytes of every id, at the id's place; ids without a rank are null."""
    table = ranks(path)
    tokens: list[bytes | None] = [None] * (max(table.values()) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary())


def pieces(text: str, chunk: int = CHUNK_CHARS) -> list[str]:
    """The text cut at safe boundaries into pieces of about ``chunk`` characters."""
    out, at = [], 0
    while len(text) - at > chunk:
        cut = _BOUNDARY.search(text, at + chunk)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def encode(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Ids of each text, ``array<int>``; special tokens' strings are ordinary text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        bpe, parts, bounds = encoding(path, pattern), [], [0]
        for text in texts.to_pylist():
            total = 0
            for piece in pieces(text or ""):
                part = bpe.encode_to_numpy(piece, disallowed_special=())
                parts.append(part)
                total += len(part)
            bounds.append(bounds[-1] + total)
        values = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The raw bytes of each list of ids, not decoded as text."""

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        lists = lists.fill_null([]) if lists.null_count else lists
        bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
        found = token_bytes(path).take(lists.flatten())
        if found.null_count:
            raise ValueError("an id is not in the rank file")
        if not len(found):
            return pa.array([b""] * len(lists), pa.binary())
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
        starts = np.ascontiguousarray(ends[bounds])
        joined = pa.Array.from_buffers(
            pa.large_binary(), len(lists), [None, pa.py_buffer(starts), found.buffers()[2]]
        )
        return joined.cast(pa.binary())

    return raw(ids)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, ids`` of every text."""
    rows = keyed_text(docs, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), encode(F.col("text"), path).alias("ids"))
