"""Every registered query against its independently written DuckDB SQL."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from fixture_dirs import SF_SMALL
from tools.oracle_check import TABLES, rows_of

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_is_registered_with_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "rolling_sum_24hr_org" in df.columns


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) >= 60


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    a, ac = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.execute(SQL[name])
    b, bc = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert ac == bc
    assert len(a) == len(b)
    assert a == b
