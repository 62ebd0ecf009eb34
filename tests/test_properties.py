"""Distributed operators against brute force on small skewed inputs: a hot
value, a hot scope, long series split into many chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from perilscope.operators import order as OR
from perilscope.operators import reshape as RS
from perilscope.operators import scale as SL
from perilscope.operators import series as S
from perilscope.plans import model as M


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    scope = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c", "d"], n))
    value = np.round(rng.normal(size=n), 2)
    value[rng.random(n) < 0.3] = 0.0          # a hot value
    value[rng.random(n) < 0.05] = np.nan       # missing values
    pdf = pd.DataFrame({"id": np.arange(n), "scope": scope, "v": value})
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df


def test_dense_rank_global_and_scoped(skewed):
    pdf, df = skewed
    got = OR.dense_rank(df, "v", "rk", num_partitions=7).toPandas().set_index("id")
    exp = pdf["v"].rank(method="dense", ascending=False)
    assert (got.loc[pdf["id"], "rk"].fillna(-1).values == exp.fillna(-1).values).all()
    got = OR.dense_rank(df, "v", "rk", scope=["scope"], num_partitions=7).toPandas().set_index("id")
    exp = pdf.groupby("scope")["v"].rank(method="dense", ascending=False)
    assert (got.loc[pdf["id"], "rk"].fillna(-1).values == exp.fillna(-1).values).all()


def test_dense_rank_ascending(skewed):
    pdf, df = skewed
    got = OR.dense_rank(df, "v", "rk", descending=False, num_partitions=5).toPandas().set_index("id")
    exp = pdf["v"].rank(method="dense", ascending=True)
    assert (got.loc[pdf["id"], "rk"].fillna(-1).values == exp.fillna(-1).values).all()


@pytest.mark.parametrize("rows,guess", [(10 ** 6, None), (40, None), (5, None), (5, 1e-9)])
def test_exact_quantiles(skewed, monkeypatch, rows, guess):
    """Ranges counted whole, brackets narrowed until small, and first guesses
    so tight that brackets miss and have to be widened."""
    pdf, df = skewed
    if guess:
        monkeypatch.setattr(OR, "_rank_error", lambda k: guess)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = OR.exact_quantiles(df, "v", qs, scope=["scope"], k=8, bracket_rows=rows).toPandas()
    assert sorted(got["scope"]) == sorted(pdf["scope"].unique())
    for _, r in got.iterrows():
        vals = pdf.loc[pdf["scope"] == r["scope"], "v"].dropna()
        for i, q in enumerate(qs):
            assert abs(r[f"q{i}"] - vals.quantile(q)) < 1e-12
    glob = OR.exact_quantiles(df, "v", [0.5], k=8, bracket_rows=rows).first()[0]
    assert abs(glob - pdf["v"].dropna().median()) < 1e-12


def test_exact_quantiles_of_hot_values_and_nothing(spark):
    vals = [0.0] * 500 + [1.0, 2.0, 3.0] + [-1.0] * 10
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for rows in (10, 10 ** 6):
        got = OR.exact_quantiles(df, "v", [0.0, 0.5, 0.99, 1.0], k=8, bracket_rows=rows).first()
        exp = pd.Series(vals).quantile([0.0, 0.5, 0.99, 1.0]).tolist()
        assert [round(x, 12) for x in got] == [round(x, 12) for x in exp]
    none = OR.exact_quantiles(df.where("false"), "v", [0.5]).collect()
    assert [tuple(r) for r in none] == [(None,)]
    odd = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None)], "s string, v double")
    got = OR.exact_quantiles(odd, "v", [0.5], ["s"]).collect()
    assert {tuple(r) for r in got} == {(None, 1.5), ("a", None)}


@pytest.mark.parametrize("accuracy,limit", [(10_000, 10 ** 6), (20, 10 ** 6), (20, 40), (5, 3)])
def test_column_summary_equals_pandas(spark, accuracy, limit):
    """Small and bracketed columns, hot values, narrowing until a bracket is small."""
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": np.round(rng.lognormal(size=n), 1),
                        "c": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)),
                        "d": np.full(n, np.nan), "e": np.full(n, 7.0)})
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(pdf)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])
    for x in OR.column_summary(df, list(pdf.columns), qs, accuracy, limit):
        col = pdf[x["column"]].dropna()
        assert x["count"] == len(col)
        if len(col):
            assert np.allclose(x["q"], col.quantile(qs), atol=1e-12)
            assert np.isclose(x["mean"], col.mean()) and np.isclose(x["std"], col.std())
        else:
            assert x["q"] == [None] * len(qs)


def test_column_medians_all_missing_column(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (2.0, None)], "a double, b double")
    r = OR.column_medians(df, ["a", "b"]).first()
    assert r["a"] == 2.0 and r["b"] is None


@pytest.mark.parametrize("partitions", [3, 17, 150])
def test_ranged_windows_equal_plain_windows(spark, partitions):
    rng = np.random.default_rng(partitions)
    recs = []
    for e, n in [("hot", 400), ("x", 30), ("y", 3), ("z", 1)]:
        periods = np.sort(rng.choice(np.arange(0, 2000), n, replace=False))
        for p in periods:
            v = None if rng.random() < 0.2 else float(np.round(rng.normal(), 3))
            recs.append((e, int(p), v))
    df = spark.createDataFrame(recs, "e string, p int, v double")

    def cols(w):
        return {"lead": S.lead1("v", w), "lag": S.lag1("v", w),
                "m3": S.rolling_mean("v", w, 3), "s5": S.rolling_std("v", w, 5),
                "t5": S.rolling_trend("v", w, 5)}
    a = S.with_series_columns(df, "e", "p", cols, partitions=partitions).toPandas()
    plain = cols(Window.partitionBy("e").orderBy("p"))
    b = df.select("*", *[e.alias(n) for n, e in plain.items()]).toPandas()
    a = a.sort_values(["e", "p"]).reset_index(drop=True)
    b = b.sort_values(["e", "p"]).reset_index(drop=True)
    assert len(a) == len(recs)
    pd.testing.assert_frame_equal(a, b, check_exact=False, atol=1e-9)


@pytest.mark.parametrize("partitions", [60, 9])
@pytest.mark.parametrize("back,ahead", [(0, 1), (1, 0), (2, 0), (4, 0), (4, 1), (3, 3)])
def test_every_halo_equals_plain_windows(spark, back, ahead, partitions):
    """Each reach on its own, over boundaries, gaps and one-row partitions."""
    rng = np.random.default_rng(10 * back + ahead)
    recs = [(e, int(p), float(np.round(rng.normal(), 3)))
            for e, n in [("hot", 60), ("x", 5), ("z", 1)]
            for p in np.sort(rng.choice(np.arange(0, 150), n, replace=False))]
    df = spark.createDataFrame(recs, "e string, p int, v double")

    def cols(w):
        out = {f"lag{i}": F.lag("v", i).over(w) for i in range(1, back + 1)}
        return out | {f"lead{i}": F.lead("v", i).over(w) for i in range(1, ahead + 1)}

    plain = cols(Window.partitionBy("e").orderBy("p"))
    got, want = (x.toPandas().sort_values(["e", "p"]).reset_index(drop=True) for x in (
        S.with_series_columns(df, "e", "p", cols, back, ahead, partitions),
        df.select("*", *[e.alias(n) for n, e in plain.items()])))
    assert len(got) == len(recs)
    pd.testing.assert_frame_equal(got, want)


def test_one_entity_spreads_evenly(spark):
    """All rows belong to one entity: its windows run in many tasks of like size."""
    df = spark.range(20_000).select(F.lit("only").alias("e"), F.col("id").alias("p"),
                                    (F.col("id") % 7).alias("v"))
    seen = S.with_series_columns(df, "e", "p", lambda w: {
        "task": F.spark_partition_id(), "lag": F.lag("v", 1).over(w),
        "n": F.count(F.lit(1)).over(w.rowsBetween(-10 ** 6, 10 ** 6))}, 4, 1, 16)
    sizes = [r.n for r in seen.select("n").distinct().collect()]
    assert len(sizes) >= 8 and max(sizes) < 3 * 20_000 / 16
    assert seen.where("lag is null").count() == 1


def test_merged_moments_equal_one_pass(spark):
    """Parts of any size, also empty and constant ones, far from zero."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "part": rng.integers(0, 7, 400),
                        "v": 1e7 + rng.normal(size=400), "w": 5.0})
    pdf.loc[pdf["part"] == 3, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    merged = SL.merge_moments(SL.moments(df, ["v", "w"], ["g", "part"]), ["v", "w"], ["g"])
    for r in merged.collect():
        own = pdf[pdf["g"] == r["g"]]
        for c in ("v", "w"):
            v = own[c].dropna()
            assert r[c]["n"] == len(v) and r[c]["mean"] == pytest.approx(v.mean(), rel=1e-14)
            assert r[c]["m2"] == pytest.approx(((v - v.mean()) ** 2).sum(), rel=1e-6, abs=1e-6)
    plain = SL.zscore(df, {"v": "z"}, ["g"]).select("v", "z").toPandas()
    kept = SL.zscore(df, {"v": "z"}, ["g"], fitted=merged).select("v", "z").toPandas()
    pd.testing.assert_frame_equal(plain.sort_values("v", ignore_index=True),
                                  kept.sort_values("v", ignore_index=True), atol=1e-6)


def test_row_numbers_follow_the_order(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"i": np.arange(500), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf).repartition(6)
    got = OR.row_numbers(df, [F.col("v").desc(), F.col("i")]).toPandas().sort_values("ordinal")
    want = pdf.sort_values(["v", "i"], ascending=[False, True])
    assert got["ordinal"].tolist() == list(range(1, 501))
    assert got["i"].tolist() == want["i"].tolist()
    assert OR.row_numbers(df.where("false"), [F.col("i")]).count() == 0


def test_merge_counts_the_rows_of_a_cell(spark):
    """A repeated key is an error, or multiplies rows as outer joins do."""
    rows = {"flood": [("A", 1, 1.0), ("A", 1, 2.0), ("B", 1, 3.0), (None, 1, 9.0)],
            "drought": [("A", 1, 5.0), ("A", 1, None), ("C", 2, 6.0), (None, 1, 8.0)],
            "storms": [("A", 1, 7.0)]}
    frames = {h: spark.createDataFrame(r, "country string, period int, impact double")
              for h, r in rows.items()}
    keys, values = ["country", "period"], {"impact": "{h}_impact"}
    with pytest.raises(Exception, match="more than one row of"):
        RS.merge_hazards(frames, keys, values).collect()
    want = pd.DataFrame({"country": pd.Series(dtype=object), "period": pd.Series(dtype="int64")})
    for h, r in rows.items():
        want = want.merge(pd.DataFrame(r, columns=[*keys, f"{h}_impact"]), on=keys, how="outer")
    got = RS.merge_hazards(frames, keys, values, repeats="multiply").toPandas()
    show = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object)
                                .where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert show(got) == show(want) and len(want) == 7
    once = {h: f.dropDuplicates(keys) for h, f in frames.items()}
    assert RS.merge_hazards(once, keys, values).count() == 4


def test_contiguous_folds_match_ntile(spark):
    n = 100
    df = spark.createDataFrame([(f"c{i // 7}", i % 7) for i in range(n)],
                               "country string, period int")
    got = M.contiguous_folds(df, ["country", "period"], 3).toPandas()
    got = got.sort_values(["country", "period"]).reset_index(drop=True)
    sizes = got.groupby("fold").size().tolist()
    assert sizes == [34, 33, 33]
    assert got["fold"].is_monotonic_increasing


def test_latest_in_picks_newest_in_window(spark):
    df = spark.createDataFrame([("a", 1997, 1.0), ("a", 2000, 2.0), ("a", 2003, 3.0),
                                ("b", 1990, 4.0)], "country string, period int, v double")
    got = {r["country"]: (r["period"], r["v"]) for r in
           S.latest_in(df, "country", "period", 1998, 2001).collect()}
    assert got == {"a": (2000, 2.0)}


def test_group_statistics_reach_the_rows_without_dealing_them_by_group(spark):
    """Beyond the broadcast threshold too, rows stay where they are, and
    the hazard merge groups by its keys alone."""
    df = spark.createDataFrame([(f"c{i}", i // 8, "ab"[i % 2], float(i)) for i in range(40)],
                               "country string, period int, g string, v double")
    key, old = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get(
        "spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        z = SL.zscore(df, {"v": "z"}, ["g"])
        plan = z._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        wide = RS.merge_long(z, ["country", "period"], "g", ["a", "b"], {"z": "{h}_z"})
        assert "pivotfirst" not in wide._jdf.queryExecution().executedPlan().toString()
        assert [(r["a_z"] is None, r["b_z"] is None) for r in wide.orderBy("period", "country")
                .where("country IN ('c0', 'c1')").collect()] == [(False, True), (True, False)]
    finally:
        spark.conf.set(key, old)


def test_wide_damage_groups_once(spark):
    """every rebuild groups the damage by its keys alone; unknown and missing
    hazards and keys keep their row."""
    from perilscope.sources import driver_tables as D
    rows = [("A", 1, "flood", 2.0, 4), ("A", 1, "storms", 1.0, 4), ("A", 2, None, 1.0, 1),
            (None, 1, "drought", 3.0, 4), ("B", 1, "other", 1.0, 1), ("C", 1, "flood", 1.0, 0)]
    facts = spark.createDataFrame(rows, "country string, year int, hazard string, "
                                        "disc_sum double, disc_n bigint")
    wide = D.damage_wide(facts)
    assert "pivotfirst" not in wide._jdf.queryExecution().executedPlan().toString()
    got = {(r["country"], r["year"]): (r["drought"], r["flood"], r["storm"], r["extreme_temp"])
           for r in wide.collect()}
    assert got == {("A", 1): (None, 50.0, 25.0, None), ("A", 2): (None,) * 4,
                   (None, 1): (75.0, None, None, None), ("B", 1): (None,) * 4}
