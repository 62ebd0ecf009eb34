"""Every registered query with SQL against DuckDB at the smallest scale
(the driver runs the same check at sf0.01)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = E.oracle_sql()
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 5)
    return v


def key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = sorted((tuple(norm(v) for v in r) for r in df.collect()), key=key)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == sorted(cols)
    idx = [rel.columns.index(c) for c in cols]
    exp = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=key)
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["country", "period"]
