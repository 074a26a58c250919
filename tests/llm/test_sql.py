"""Queries against their SQL on the given tables."""

import duckdb
import pyarrow.dataset as ds
import pytest

from lodestone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.register(t, ds.dataset(f"{folder}/{t}.parquet").to_table())
    got, want = queries.queries()[name](spark, folder).toArrow(), con.sql(queries.oracle_sql()[name]).to_arrow_table()
    c = sorted(got.column_names)
    assert c == sorted(want.column_names)
    plain = lambda t: sorted(tuple(map(str, r)) for r in zip(*(t.column(n).to_pylist() for n in c)))
    assert plain(got) == plain(want)
