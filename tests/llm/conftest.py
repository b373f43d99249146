import os
import random

import pytest

from tracelake.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


#: A null text, an empty one, ties, a repeated row, a very long text and columns that clash.
def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "déjà", "x", "idiot", "42", "#tag"]
    long = " ".join(rng.choice(words) + str(rng.randrange(9000)) for _ in range(40_000))
    rows = [
        (1, None, 1, "a"), (2, "", 2, "b"), (3, "one two", 3, None), (4, "one two", 4, "c"),
        (5, long, 5, "d"), (5, long, 5, "d"), (6, " \t\n", 6, "e"), (7, "é" * 900, 7, "f"),
        (None, "no id here at all but words", 8, "g"), (8, long + " tail", None, "h"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, ties and columns named like the operators' own."""
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, id long, ids string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
