"""Corpus queries against their SQL."""

import os

import duckdb
import pytest

from mapweave.llm import queries

MID = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(MID):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{MID}/{f}'")
    df = queries.QUERIES[name](spark, MID)
    rows = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = rel.project(",".join(f'"{c}"' for c in sorted(rel.columns))).fetchall()
    assert rows and rows == sorted(tuple(map(str, r)) for r in want)
