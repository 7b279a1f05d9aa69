"""Every query of this subpackage that has SQL gives the SQL's rows, on the smallest tables."""

import os

import pytest

from sketchloom.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in cur.description)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in cur.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want and want
