"""The audit against plain loops, over files that arrive in any order."""

import re
from collections import Counter
from itertools import permutations

import pytest

from tracelake.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, part string, mask int"
WORDS = " ".join(f"w{k}" for k in range(120))


def fails(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
        row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows),
    )


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    table, shares = Counter(), Counter()
    judged = [(r, r[2] or "", fails(r, rows)) for r in rows]
    parts = {p for _, p, _ in judged}
    for order in permutations(range(5)):
        name = "".join("ABCDE"[k] for k in order)
        for r, part, failed in judged:
            gone = False
            for step, k in enumerate(order, 1):
                at = (part, name, step)
                if not failed[k]:
                    table[at, "kept"] += not gone
                    continue
                table[at, "unique_fails"] += sum(failed) == 1
                table[at, "redundant"] += gone
                table[at, "removed"] += not gone
                table[at, "good_lost"] += not gone and r[0] in good
                table[at, "toxic_lost"] += not gone and r[0] in toxic
                shares[part, k] += not gone
                gone = True
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {
        (p, "".join("ABCDE"[k] for k in order), step): (*(table[(p, "".join("ABCDE"[k] for k in order), step), n] for n in names), shares[p, k])
        for p in parts
        for order in permutations(range(5))
        for step, k in enumerate(order, 1)
    }


ROWS = [
    (5, WORDS, "en", "x", 1), (3, WORDS, "de", "x", 2), (3, WORDS, "de", None, 2), (9, WORDS, None, "x", 3),
    (None, WORDS, "en", "y", 4), (4, None, "en", "x", 1), (7, "", "en", "x", 1), (2, "", "", "x", None),
    (8, "A B # " * 60, "de", "x", 1), (1, "word " * 90_000, "en", "x", 1), (6, WORDS.upper(), "fr", "x", 1),
    (11, WORDS + " ärger %", "fr", "x", 1), (10, WORDS + " ärger %", "fr", "x", 1), (-4, WORDS.upper(), "en", "x", 1),
]
LABELS = [(5, 1, 0), (5, 0, 1), (3, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0), (10, 1, 0)]


def result(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_smaller_ids_arrive_later(spark, labels, tmp_path):
    """Every file is a micro-batch; a second call adds files with smaller ids to the same folder."""
    docs, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    for k in range(0, len(ROWS), 2):
        spark.createDataFrame(ROWS[k : k + 2], SCHEMA).coalesce(1).write.mode("append").parquet(docs)
    got = result(filter_audit.audit(spark, docs, labels, folder, batches=100))
    assert got == plain(ROWS, LABELS)
    more = [(0, WORDS, "es", "x", 1), (10, WORDS + " ärger %", "es", "x", 1), (1, "", "en", "x", 1)]
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(docs)
    assert result(filter_audit.audit(spark, docs, labels, folder)) == plain(ROWS + more, LABELS)


def test_one_batch_with_few_texts_a_bucket(spark, labels, tmp_path, monkeypatch):
    monkeypatch.setattr(filter_audit, "TEXTS", 3)
    docs = str(tmp_path / "docs")
    copies = [(k, WORDS, "en", "x", 1) for k in range(40, 90)] + ROWS
    spark.createDataFrame(copies, SCHEMA).repartition(3).write.parquet(docs)
    assert result(filter_audit.audit(spark, docs, labels, batches=1)) == plain(copies, LABELS)


def test_empty_table(spark, labels, tmp_path):
    docs = str(tmp_path / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(docs)
    assert filter_audit.audit(spark, docs, labels).count() == 0
