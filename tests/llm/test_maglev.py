from collections import Counter

import pytest

from check import compare, database
from tracelake.llm import maglev
from tracelake.llm.queries import ORACLE, SHARDS, op2_maglev

from .conftest import SF


def test_query_equals_sql(spark):
    assert compare(op2_maglev(spark, SF), database(SF), ORACLE["op2_maglev"]) == ""


def test_shares_and_moves():
    table = maglev.fill(SHARDS)
    shares = Counter(table)
    assert set(shares) == set(range(16)) and max(shares.values()) - min(shares.values()) <= 1
    without = maglev.fill(SHARDS[:7] + SHARDS[8:])
    names = SHARDS[:7] + SHARDS[8:]
    moved = sum(SHARDS[a] != names[b] for a, b in zip(table, without) if SHARDS[a] != SHARDS[7])
    assert moved < 0.15 * len(table)


def test_placement_is_native_and_without_shuffle(spark, documents):
    plan = maglev.place(documents, "doc_id", SHARDS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd, empty):
    rows = odd.selectExpr("*", "'mine' AS shard", "1 AS slot")
    for key in ("doc_id", "text"):
        got = maglev.place(rows, key, ["a", "b", "c"], 211).collect()
        assert len(got) == odd.count()
        by = {}
        for r in got:
            assert r["shard"] in ("a", "b", "c") and by.setdefault(r[key], r["shard"]) == r["shard"]
    assert maglev.place(empty, "text", ["a"], 3).count() == 0
    for shards, slots in (([], 7), (["a", "b", "c"], 2), (["a"], 9)):
        with pytest.raises(ValueError):
            maglev.fill(shards, slots)
