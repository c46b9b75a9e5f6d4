"""Every core query against its SQL on the smallest tables."""

import importlib

import pytest

from conftest import same

MODULES = [importlib.import_module(f"evidentia.plans.{m}") for m in ("scalar_queries", "relational_queries", "graph_queries", "pipeline_queries", "problems")]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, duck, ORACLES[name])
    else:
        assert len(set(df.columns)) == len(df.columns)
        df.collect()


def test_names_are_unique():
    assert sum(len(m.QUERIES) for m in MODULES) == len(QUERIES)


def test_entry_has_rows(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
