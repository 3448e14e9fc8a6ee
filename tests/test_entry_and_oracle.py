import pytest

import __spark_entry__ as E
from tablelens.plans.catalog import ORACLE, QUERIES
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"

def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "value", "rolling"]
    assert df.count() > 0


def test_every_query_has_sql_or_is_documented():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) == set(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, QUERIES[name], ORACLE.get(name), SF, con)
    assert r["ok"] is not False, r


def test_entry_survives_operators_that_cannot_be_imported(monkeypatch):
    import sys
    monkeypatch.setitem(sys.modules, "tablelens.llm.queries", None)  # importing it raises ImportError
    assert set(E.queries()) == set(QUERIES) and set(E.oracle_sql()) == set(ORACLE)
