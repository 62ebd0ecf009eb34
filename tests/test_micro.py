"""Hand-computed micro fixtures (FIXTURES.md §4), one per semantic trap."""

import math

import pytest
from pyspark.sql import functions as F

from perilscope.config import HAZARDS
from perilscope.functions import rowwise as RW
from perilscope.functions import scalar as SC
from perilscope.operators import aggregate as AG
from perilscope.operators import filters as FL
from perilscope.operators import order as OR
from perilscope.operators import scale as SL
from perilscope.operators import series as S
from perilscope.plans import builders as B
from perilscope.plans import features as FE
from perilscope.sources.schema import normalise_nan

IMPACTS = [f"{h}_impact" for h in HAZARDS]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:2]).collect()]


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol


@pytest.fixture(scope="module")
def gaps(spark):
    data = [("A", 2000, 1.0), ("A", 2001, None), ("A", 2002, 4.0), ("A", 2005, 3.0),
            ("A", 2006, 9.0), ("A", 2007, 2.0), ("B", 2000, None), ("B", 2001, 5.0)]
    return spark.createDataFrame(data, "country string, period int, v double")


@pytest.mark.parametrize("partitions", [None, 3, 8])
def test_gaps_trend_and_rolling(gaps, partitions):
    out = S.with_series_columns(gaps, "country", "period", lambda w: {
        "trend": S.rolling_trend("v", w, 5),
        "mean3": S.rolling_mean("v", w, 3),
        "std5": S.rolling_std("v", w, 5),
        "lead": S.lead1("v", w),
        "lag": S.lag1("v", w),
    }, partitions=partitions)
    got = {(r["country"], r["period"]): r for r in out.collect()}
    expect_trend = {("A", 2000): 0, ("A", 2001): 0, ("A", 2002): 3, ("A", 2005): 1,
                    ("A", 2006): 2.3, ("A", 2007): 0, ("B", 2000): 0, ("B", 2001): 0}
    for k, v in expect_trend.items():
        assert close(got[k]["trend"], v), (k, got[k]["trend"])
    # rolling mean of the last 3 rows skips missing values
    assert close(got[("A", 2002)]["mean3"], 2.5)
    assert close(got[("A", 2005)]["mean3"], 3.5)
    assert got[("B", 2000)]["mean3"] is None
    # sample std over 5 rows; one value → 0
    assert close(got[("A", 2000)]["std5"], 0.0)
    assert close(got[("A", 2002)]["std5"], math.sqrt(4.5))
    # lead / lag by row, not by year
    assert got[("A", 2002)]["lead"] == 3.0 and got[("A", 2005)]["lag"] == 4.0
    assert got[("A", 2007)]["lead"] is None and got[("A", 2000)]["lag"] is None
    assert len(got) == 8


def test_allnull_group(spark):
    df = spark.createDataFrame([("X", 2000, 1.0, None), ("X", 2000, 2.0, None)],
                               "country string, year int, affected double, death double")
    tot = AG.agg_total(df, ["country", "year"]).first()
    assert tot["total_deaths"] == 0.0 and tot["total_affected"] == 3.0
    mean = AG.agg_mean(df, ["country", "year"]).first()
    assert mean["death"] is None and mean["affected"] == 1.5 and mean["events"] == 2


def test_one_measure_gives_null_impact_and_no_count(spark):
    df = spark.createDataFrame(
        [("X", 2000, "flood", 10.0, None), ("Y", 2000, "flood", 5.0, 1.0),
         ("Z", 2000, "flood", 7.0, 2.0), ("X", 2000, "drought", 3.0, 1.0),
         ("Y", 2000, "drought", 4.0, 2.0)],
        "country string, year int, hazard string, affected double, death double")
    wide = B.impact_index(B.merge_impacts(B.hazard_impact(df)))
    x = wide.where("country = 'X'").first()
    assert x["flood_impact"] is None
    assert x["drought_impact"] is not None
    assert x["hazard_count"] == 1
    assert close(x["climate_impact_index"], x["drought_impact"])


def test_constant_column_zscore_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "k int, v double")
    out = SL.zscore(df, {"v": "z"}).collect()
    assert all(r["z"] == 0.0 for r in out)


def test_single_train_row_gives_null(spark):
    df = spark.createDataFrame([(1999, 2.0), (2000, 3.0)], "period int, v double")
    out = SL.zscore_train(df, F.col("v"), "z", "period", 1999).collect()
    assert all(r["z"] is None for r in out)


def test_negative_year_floor(spark):
    df = spark.createDataFrame([(-3,), (7,), (-5,), (0,)], "y int")
    got = [r[0] for r in df.select(SC.bin_period("y", 5)).collect()]
    assert got == [-5, 5, -5, 0]


def test_no_affected_rate_zero(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 0.0), (3.0, 6.0)],
                               "d double, a double")
    got = [r[0] for r in df.select(SC.value_or_zero_ratio("d", "a")).collect()]
    assert got == [0.0, 0.0, 0.5]


def test_uneven_missing_damage(spark):
    wide = spark.createDataFrame(
        [("X", 2000, 1.0, 3.0, None, None), ("X", 2001, 5.0, None, None, None)],
        "country string, year int, drought double, flood double, storm double, "
        "extreme_temp double")
    yearly = {r["period"]: r["economic_damage_pct_gdp"]
              for r in B.damage_yearly(wide).collect()}
    assert yearly == {2000: 2.0, 2001: 5.0}
    binned = B.damage_binned(wide).first()["economic_damage_pct_gdp"]
    # mean of per-hazard means (drought 3, flood 3) ≠ mean of all values (3)
    assert close(binned, 3.0)
    wide2 = spark.createDataFrame(
        [("X", 2000, 1.0, 4.0, None, None), ("X", 2001, 5.0, None, None, None)],
        wide.schema)
    assert close(B.damage_binned(wide2).first()["economic_damage_pct_gdp"], 3.5)
    pooled = (1.0 + 4.0 + 5.0) / 3
    assert not close(3.5, pooled)


def test_ties_dense_rank_and_topk(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", None)],
                               "country string, s double")
    ranked = {r["country"]: r["rk"] for r in OR.dense_rank(df, "s", "rk").collect()}
    assert ranked == {"a": 1, "b": 1, "c": 2, "d": None}
    top = OR.top_k(OR.dense_rank(FL.drop_null(df, "s"), "s", "rk"),
                   [F.col("rk"), F.col("country")], 2)
    assert [r["country"] for r in top.collect()] == ["a", "b"]


def test_argmax_tie_null(spark):
    df = spark.createDataFrame([(1, 2.0, 2.0, None), (2, None, 1.0, 3.0),
                                (3, None, None, None)], "k int, a double, b double, c double")
    got = {r["k"]: r["m"] for r in df.select("k", RW.row_argmax(["a", "b", "c"]).alias("m")).collect()}
    assert got == {1: "a", 2: "c", 3: None}


def test_entity_names_exact_match(spark):
    df = spark.createDataFrame([("European Union",), ("European Union (27)",), (None,)],
                               "country string")
    kept = [r[0] for r in FL.exclude_entities(df, "country", ["European Union", "EU"]).collect()]
    assert sorted(kept, key=lambda x: (x is None, x)) == ["European Union (27)", None]


def test_short_history_dropped(spark):
    rows_ = []
    for c, years in [("LONG", range(1995, 2002)), ("SHORT", range(1996, 2000))]:
        for y in years:
            rows_.append((c, y, 1.0 + y % 3, 0.5, 10.0, 1.0))
    df = spark.createDataFrame(rows_, "country string, period int, climate_impact_index double, "
                                      "impact_rebased double, total_affected double, total_deaths double")
    for h in IMPACTS:
        df = df.withColumn(h, F.col("climate_impact_index"))
    df = df.withColumns({"hazard_count": F.lit(4), "economic_damage_pct_gdp": F.lit(0.0)})
    ft = FE.feature_table(df, 1999, excluded=[])
    cli = FE.composite_index(ft, 1999)
    pin = FE.prediction_input(cli, 1999, 1998, 2001)
    assert [r["country"] for r in pin.collect()] == ["LONG"]


def test_nan_input_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double")
    out = {r["k"]: r["v"] for r in normalise_nan(df).collect()}
    assert out == {1: None, 2: 1.0}


def test_rolling_mean_zero_fill_and_std_skip(spark):
    df = spark.createDataFrame([("A", 1, None), ("A", 2, None), ("A", 3, 6.0)],
                               "country string, period int, v double")
    out = S.with_series_columns(df, "country", "period", lambda w: {
        "m": SC.fill_const(S.rolling_mean("v", w, 3), 0.0)})
    assert [r["m"] for r in out.orderBy("period").collect()] == [0.0, 0.0, 6.0]
