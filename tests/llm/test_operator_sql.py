"""Queries of the subpackage against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from loomspan.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.QUERIES[name](spark, SF)
    result = con.execute(registry.SQL[name])
    names = [d[0] for d in result.description]
    order = lambda r: r.get("doc_id", r.get("vec_id"))
    want = sorted((dict(zip(names, r, strict=True)) for r in result.fetchall()), key=order)
    assert sorted((r.asDict() for r in df.collect()), key=order) == want
