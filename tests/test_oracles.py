"""Every query with SQL, compared with DuckDB on the smallest tables; all others must run."""

import glob
import math
import os

import duckdb
import pytest

from actloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    if getattr(v, "tzinfo", None):
        v = v.replace(tzinfo=None)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())
