"""Every registered query against its SQL on the smallest tables; rows-only without SQL."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from panelloom.queries import modelling

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
# On the smallest tables these SQL-checked results are legitimately empty.
EMPTY_OK = set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name, monkeypatch):
    # the whole search of 100 settings is 400 fits; the test makes 16 of them
    monkeypatch.setattr(modelling, "SEARCH_DRAWS", 4)
    ok, note = compare(spark, con, QUERIES[name], ORACLES.get(name), SF)
    assert ok or (name in EMPTY_OK and note == "0 rows"), note


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
