from types import SimpleNamespace

import pytest

from tracelake import storage


def session(master, folder=None, app="app-1"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder),
        sparkContext=SimpleNamespace(master=master, applicationId=app),
    )


def test_only_a_local_session_falls_back():
    for k, master in enumerate(("local", "local[4]", "local[*]", "local[2,3]")):
        own = session(master, app=f"fallback-{k}")
        assert storage.shared_root(own) == storage.shared_root(own)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://x"):
        with pytest.raises(RuntimeError):
            storage.shared_root(session(master))
    assert storage.shared_root(session("yarn", "hdfs://shared")) == "hdfs://shared"


def test_scratch_is_removed_for_one_session_only(spark, monkeypatch):
    kept = storage.materialize(spark.range(3), "kept")
    mine = storage._SCRATCH.pop(spark.sparkContext.applicationId)
    other = storage.materialize(spark.range(5), "other")
    assert other.count() == 5
    storage.clear_scratch(spark)
    with pytest.raises(Exception):
        spark.read.parquet(other.inputFiles()[0])
    storage._SCRATCH[spark.sparkContext.applicationId] = mine
    assert kept.count() == 3
