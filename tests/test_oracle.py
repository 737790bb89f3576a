"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from shutterlake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "events", "lineitem", "embeddings")


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in frame.collect())
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = con.execute(SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in out.fetchall())
    assert got == want
