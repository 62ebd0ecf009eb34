"""Pipeline queries on a small skewed fixture: one customer holds a third of
all orders (and one order a large share of line items), checked against the
DuckDB oracle on the same files."""

import datetime as dt
import math
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as E

NAMES = ["analysis_set_yearly", "analysis_set_binned", "hazard_share",
         "rank_by_period", "rolling_trend5", "latest_row", "describe"]


@pytest.fixture(scope="module")
def skew_dir():
    rng = np.random.default_rng(3)
    d = tempfile.mkdtemp(prefix="perilscope-skew-", dir="/tmp")
    nation = pd.DataFrame({"n_nationkey": np.arange(5, dtype="int32"),
                           "n_name": [f"NATION_{i}" for i in range(5)],
                           "n_regionkey": np.zeros(5, dtype="int32")})
    ncust = 60
    customer = pd.DataFrame({"c_custkey": np.arange(ncust, dtype="int64"),
                             "c_name": [f"Customer#{i:09d}" for i in range(ncust)],
                             "c_nationkey": (np.arange(ncust) % 5).astype("int32"),
                             "c_acctbal": np.zeros(ncust), "c_mktsegment": "X"})
    nord = 3000
    cust = np.where(rng.random(nord) < 1 / 3, 0, rng.integers(1, ncust, nord))
    days = rng.integers(0, 7 * 365, nord)
    orders = pd.DataFrame({
        "o_orderkey": np.arange(nord, dtype="int64"), "o_custkey": cust.astype("int64"),
        "o_orderstatus": rng.choice(["F", "O", "P"], nord),
        "o_totalprice": np.zeros(nord),
        "o_orderdate": [dt.datetime(1995, 1, 1) + dt.timedelta(days=int(x)) for x in days],
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED",
                                       "5-LOW"], nord)})
    nli = 12000
    okey = np.where(rng.random(nli) < 0.2, 7, rng.integers(0, nord, nli))
    lineitem = pd.DataFrame({
        "l_orderkey": okey.astype("int64"), "l_partkey": np.zeros(nli, dtype="int64"),
        "l_suppkey": np.zeros(nli, dtype="int64"), "l_linenumber": np.ones(nli, dtype="int32"),
        "l_quantity": rng.integers(1, 50, nli).astype(float),
        "l_extendedprice": np.zeros(nli), "l_discount": np.round(rng.random(nli) / 10, 2),
        "l_tax": np.zeros(nli), "l_returnflag": rng.choice(["A", "N", "R"], nli),
        "l_linestatus": "O", "l_shipdate": [dt.datetime(1996, 1, 1)] * nli})
    for name, df in [("nation", nation), ("customer", customer), ("orders", orders),
                     ("lineitem", lineitem)]:
        df.to_parquet(f"{d}/{name}.parquet", index=False, coerce_timestamps="us",
                      allow_truncated_timestamps=True)
    return d


def norm(v):
    if isinstance(v, float):
        return ("nan",) if math.isnan(v) else round(v, 5)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_skewed_fixture_matches_oracle(spark, skew_dir, name):
    con = duckdb.connect()
    for t in ["nation", "customer", "orders", "lineitem"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{skew_dir}/{t}.parquet'")
    df = E.queries()[name](spark, skew_dir)
    key = lambda r: tuple((0, "") if v is None else (1, str(v)) for v in r)
    got = sorted((tuple(norm(v) for v in r) for r in df.collect()), key=key)
    rel = con.sql(E.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in df.columns]
    exp = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=key)
    assert len(got) == len(exp) and got == exp
