import importlib

import __spark_entry__ as entry


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_smoke(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.n_added + r.n_removed + r.n_modified + r.n_unchanged > 0 for r in rows)


def test_nothing_in_the_core_needs_the_subpackage():
    catalog = importlib.import_module("actloom.catalog")
    assert not any(n.startswith("p") for n in catalog.QUERIES)
