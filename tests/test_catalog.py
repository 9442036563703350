"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows_of

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got, cols = rows_of(df.columns, df.collect())
    assert len(set(cols)) == len(cols)
    if name not in ORACLES:
        return
    rel = con.execute(ORACLES[name])
    want, want_cols = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert cols == want_cols
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
