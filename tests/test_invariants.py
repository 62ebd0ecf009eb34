"""Properties from the test strategy, on the driver tables (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from perilscope import queries as Q
from perilscope.plans import builders as B
from perilscope.sources import driver_tables as D

SF = "/root/testdata/sf0.01"


def test_zscore_mean_zero_population_std_one(spark):
    df = Q.QUERIES["zscore"](spark, SF)
    for c in ("affected_z", "deaths_z"):
        r = df.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).first()
        assert abs(r["m"]) < 1e-6 and abs(r["s"] - 1) < 1e-5


def test_shares_sum_to_one(spark):
    df = Q.QUERIES["hazard_share"](spark, SF)
    sums = df.groupBy("country").agg(F.sum("share").alias("s")).where(F.col("s").isNotNull())
    assert sums.count() > 0
    assert sums.where(F.abs(F.col("s") - 1) > 1e-5).count() == 0


@pytest.mark.parametrize("name,scope", [("rebase_global", None),
                                        ("rebase_by_period", "period"),
                                        ("rebase_by_entity", "country")])
def test_rebased_minimum_is_zero(spark, name, scope):
    df = Q.QUERIES[name](spark, SF)
    mins = (df.groupBy(scope).agg(F.min("rebased").alias("m")) if scope
            else df.agg(F.min("rebased").alias("m")))
    assert mins.where(F.col("m").isNotNull() & (F.col("m") != 0)).count() == 0


@pytest.mark.parametrize("name,scope", [("rank_by_period", "period"), ("rank_global", None)])
def test_dense_ranks_have_no_gaps(spark, name, scope):
    df = Q.QUERIES[name](spark, SF)
    keys = [scope] if scope else []
    g = df.groupBy(*keys).agg(F.countDistinct("impact_rank").alias("n"),
                              F.max("impact_rank").alias("mx"), F.min("impact_rank").alias("mn"))
    assert g.where((F.col("n") != F.col("mx")) | (F.col("mn") != 1)).count() == 0


def test_invariant_to_partitioning_and_row_order(spark):
    m = D.measures_long(D.order_facts(spark, SF, "sparse"))
    shuffled = m.repartition(7).orderBy(F.rand(11)).repartition(3)

    def rows(df):
        out = B.hazard_impact(df).select(
            "country", "period", "hazard", F.round("impact", 9).alias("impact"))
        return sorted(tuple(r) for r in out.collect())
    assert rows(m) == rows(shuffled)


@pytest.mark.parametrize("binned", [False, True])
def test_separate_totals_input_matches_builder_chain(spark, binned):
    """Impacts and totals from different inputs (per-capita vs total-count
    files in the reference): the fused table equals the builder chain."""
    from perilscope.functions.scalar import value_or_zero_ratio
    from perilscope.operators import joins as J
    from perilscope.plans import analysis as A
    f = D.order_facts(spark, SF, "sparse")
    how = "inner" if binned else "full"
    m = D.measures_long(f, how)
    imp_m, tot_m = m.where("year <= 2000"), m.where("year >= 1997")
    size = 5 if binned else None
    if binned:
        fused = A.analysis_set_binned(imp_m, D.damage_wide(f), sort=False,
                                      total_measures=tot_m)
        chain = J.assemble_left(A.impact_part(imp_m, period_size=5),
                                A.totals_part(tot_m, period_size=5),
                                B.damage_binned(D.damage_wide(f)))
    else:
        fused = A.analysis_set_yearly(imp_m, D.damage_wide(f), sort=False,
                                      total_measures=tot_m)
        chain = J.assemble_full(A.impact_part(imp_m), A.totals_part(tot_m),
                                B.damage_yearly(D.damage_wide(f)))
    chain = chain.select(
        *[c for c in A.ANALYSIS_COLUMNS if c not in (
            "resilience_rate", "resilience_per_100k", "economic_damage_pct_gdp")],
        value_or_zero_ratio("total_deaths", "total_affected").alias("resilience_rate"),
        F.coalesce("economic_damage_pct_gdp", F.lit(0.0)).alias("economic_damage_pct_gdp"))
    assert size in (None, 5)

    def rows(df):
        cols = [c for c in A.ANALYSIS_COLUMNS if c != "resilience_per_100k"]
        out = df.select(*[F.round(c, 6).alias(c) if c not in ("country", "period", "hazard_count")
                          else F.col(c) for c in cols])
        return sorted((tuple(r) for r in out.collect()),
                      key=lambda r: tuple((v is None, str(v)) for v in r))
    a, b = rows(fused), rows(chain)
    assert len(a) == len(b) and a == b


def test_single_hazard_frames_equal_long_form(spark):
    """The reference's shape — one frame per hazard, merged by J3 — equals
    the hazard-as-key path."""
    from perilscope.config import HAZARDS
    from perilscope.operators.reshape import merge_hazards
    m = D.measures_long(D.order_facts(spark, SF, "sparse"))
    frames = {h: B.hazard_impact(D.hazard_frame(m, h), hazard=None, name=h)
              .withColumnRenamed(f"{h}_impact", "impact") for h in HAZARDS}
    per_frame = merge_hazards(frames, ["country", "period"], {"impact": "{h}_impact"})
    long_form = B.merge_impacts(B.hazard_impact(m))

    def rows(df):
        out = df.select("country", "period",
                        *[F.round(f"{h}_impact", 9).alias(h) for h in HAZARDS])
        return sorted((tuple(r) for r in out.collect()),
                      key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows(per_frame) == rows(long_form)
    tot = B.hazard_total(D.hazard_frame(m, "storms"), hazard=None, name="storm")
    assert tot.columns == ["country", "period", "storm_total_affected", "storm_total_deaths"]


@pytest.mark.parametrize("grain,expected", [("sparse", (7820, 14, 1722)),
                                            ("gappy", (1974, 380, 17)),
                                            ("model", (675, 565, 1)),
                                            ("dense", (175, 175, 0))])
def test_standin_grains_match_fixture_counts(spark, grain, expected):
    """(E,P) rows, rows with four impacts, rows with none — FIXTURES §3."""
    from perilscope.plans import analysis as A
    idx = A.impact_part(D.measures_long(D.order_facts(spark, SF, grain)))
    r = idx.agg(F.count(F.lit(1)).alias("n"),
                F.count_if(F.col("hazard_count") == 4).alias("complete"),
                F.count_if(F.col("hazard_count") == 0).alias("none")).first()
    assert (r["n"], r["complete"], r["none"]) == expected
