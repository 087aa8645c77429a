"""Every core query runs over the smallest tables and agrees with its SQL; names are unique over all modules."""

import importlib

import pytest

import __spark_entry__ as entry
from tests import oracle

MODULES = [importlib.import_module(f"mullion.plans.{m}") for m in entry.PLANS]
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, oracle.DATA)
    if name in SQL:
        assert oracle.differences(df, con, SQL[name]) == ([], [])
    else:
        assert df.columns and df.count() >= 0


def test_names_are_unique():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_queries_survive_a_missing_package(monkeypatch):
    """A None in sys.modules makes an import raise, as a missing package does."""
    import sys

    for name in [m for m in sys.modules if m == "mullion.llm" or m.startswith("mullion.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "mullion.llm.queries", None)
    with pytest.warns(UserWarning, match="no llm queries"):
        assert set(entry.queries()) == set(QUERIES)
    with pytest.warns(UserWarning, match="no llm queries"):
        assert set(entry.oracle_sql()) == set(SQL)
