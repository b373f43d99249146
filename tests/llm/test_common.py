import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracelake.llm.common import hash_sample, slabs
from tracelake.llm.components import sorted_runs


def test_hash_sample(spark):
    rows = spark.range(5000).repartition(7)
    ids = [r[0] for r in hash_sample(rows, 300, "id").collect()]
    assert len(set(ids)) == 300
    assert ids == [r[0] for r in hash_sample(rows.repartition(3), 300, "id").collect()]
    inside = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit((1 << 30) * 1360 // 5000))
    assert inside.count() < 1600 and set(ids) <= {r[0] for r in inside.collect()}
    assert hash_sample(rows, 6000, "id").count() == 5000
    assert hash_sample(rows.limit(0), 5, "id").count() == 0


def test_slabs():
    texts = ["ab", None, "", "é" * 30, "c", "d" * 9]
    batch = pa.record_batch({"text": pa.array(texts)}).slice(0)
    for part, want in ((batch, texts), (batch.slice(1, 4), texts[1:5])):
        for limit in (1, 5, 1000):
            got = []
            for first, end, raw, offsets in slabs(part, limit=limit):
                assert end - first == len(offsets) - 1
                assert len(raw) <= limit or end - first == 1 or len(raw) == offsets[-1]
                got += [raw[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
            assert got == [t or "" for t in want]
    assert list(slabs(pa.record_batch({"text": pa.array([], pa.string())}))) == []


def test_sorted_runs():
    keys = np.sort(np.random.default_rng(0).integers(0, 30, 500))
    table = pa.record_batch({"key": keys, "place": np.arange(500)})
    for size in (1, 7, 100, 500):
        seen = []
        for rows, bounds in sorted_runs((table.slice(i, size) for i in range(0, 500, size)), "key"):
            for a, b in zip(bounds, bounds[1:]):
                assert len(set(rows.column("key")[a:b].to_pylist())) == 1
                seen.append(rows.column("key")[int(a)].as_py())
        assert seen == sorted(set(keys.tolist()))
