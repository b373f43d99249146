import pytest

import __spark_entry__ as entry
from check import compare, database
from tracelake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_every_query_has_a_check():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["job_id", "k"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert compare(entry.queries()[name](spark, SF), db, entry.oracle_sql()[name]) == ""


def test_assembled_epoch_holds_every_full_batch(spark):
    sf = SF.replace("0.001", "0.01")
    windows = entry.queries()["training_windows"](spark, sf).count()
    rows = entry.queries()["assembled_epoch"](spark, sf)
    assert rows.count() == windows // 3 // 8 * 8 * 3
    assert compare(rows, database(sf), entry.oracle_sql()["assembled_epoch"]) == ""
