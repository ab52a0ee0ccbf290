"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from vectrail import oracles, queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got = queries.queries()[name](spark, D).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    assert len(a) == len(b)
    for c in columns:
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            assert (a[c].astype(float).fillna(-9) == b[c].astype(float).fillna(-9)).all(), c
        else:
            assert (a[c].fillna("-").astype(str) == b[c].fillna("-").astype(str)).all(), c


def test_oracles_have_queries():
    assert set(SQL) <= set(queries.queries())
