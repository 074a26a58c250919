"""Every query with SQL gives what DuckDB gives; the others run and keep their schema."""

import math

import duckdb
import pyarrow.dataset as ds
import pytest

from lodestone import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, ds.dataset(f"{sf}/{t}.parquet").to_table())
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "none"
    return repr(round(float(v), 5) + 0.0) if isinstance(v, float) or type(v).__name__ == "float64" else str(v)


def rows(frame):
    c = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[c].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, sf, duck):
    got = plans.queries()[name](spark, sf).toPandas()
    if name not in plans.oracle_sql():
        assert len(got) > 0
        return
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
