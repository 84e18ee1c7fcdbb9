"""The SQL of the corpus operators against their results on the smallest tables."""

import glob
import os

import duckdb
import pytest

from millrace.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, SF)
    result = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == want
