"""Every registered query against its SQL in DuckDB, and the rest for rows and a stable schema."""

import datetime
import os

import duckdb
import pytest

from codicil import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    expected = [tuple(plain(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_give_the_same_rows_again(spark, name):
    f = registry.queries()[name]
    first, second = (sorted(map(repr, f(spark, SF).collect())) for _ in range(2))
    assert first and first == second


def test_flagship(spark):
    rows = registry.flagship(spark, SF)
    assert rows.count() > 0 and rows.columns == ["query_id", "chunk_id", "score", "fused_score", "rerank_score", "via", "rank"]
