"""Corpus queries that have SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from acrelens.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SMALL).select(*[f"`{c}`" for c in want.columns]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str) and got
