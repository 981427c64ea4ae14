"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from weirflow.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equal_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = con.execute(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_names():
    assert {f"p{n}_" for n in (1, 2, 3, 6, 7, 8)} == {q.split("_")[0] + "_" for q in QUERIES}
