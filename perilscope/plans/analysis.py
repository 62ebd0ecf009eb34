"""The country-period analysis table (C6a yearly, C6b binned).

Inputs are long measures ``(country, year, hazard, affected, death)`` and
the wide damage table.

Plan: the reference builds impacts and totals per hazard, merges each
family with a chain of full outer joins, then joins impacts, totals and
damage with two more outer joins. Here the impact and total builders share
one group-by on ``(country, period, hazard)`` (they aggregate the same
groups), the scaler's per-hazard statistics are a four-row broadcast, and
impacts, totals and the melted damage rows are unioned and folded in one
group-by on ``(country, period)``: two shuffles of the data instead of
seven group-bys and two outer joins. The folded table is written once to
the checkpoint folder, since the global rebase reads it twice. Key presence reproduces the join
types: yearly keeps every key of any part (full outer), binned keeps the
keys that have impact rows (left outer from the impact table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAMAGE_COLUMNS, HAZARDS
from ..functions.rowwise import row_mean
from ..functions.scalar import bin_period, fill_const, log1p, scale, value_or_zero_ratio
from ..operators.aggregate import not_null_keys
from ..operators.filters import drop_all_null, having_min_events
from ..operators.reshape import melt
from ..operators.scale import rebase, zscore
from ..session import stage
from . import builders as B

ANALYSIS_COLUMNS = [
    "country", "period",
    "flood_impact", "drought_impact", "storms_impact", "extreme_temp_impact",
    "climate_impact_index", "impact_rebased", "hazard_count",
    "total_deaths", "total_affected", "resilience_rate", "resilience_per_100k",
    "economic_damage_pct_gdp",
]


def impact_part(measures_long: DataFrame, period_size: int | None = None,
                min_events: int = 1, strict: bool = False) -> DataFrame:
    """C1 → J3 → C3 (the builder chain, used by the operator-level keys)."""
    long = B.hazard_impact(measures_long, period_size=period_size,
                           min_events=min_events, strict=strict)
    return B.impact_index(B.merge_impacts(long))


def totals_part(measures_long: DataFrame,
                period_size: int | None = None) -> DataFrame:
    """C2 → J3 → C4, reduced to the two totals."""
    wide = B.totals_table(B.merge_totals(
        B.hazard_total(measures_long, period_size=period_size)))
    return wide.select("country", "period", "total_deaths", "total_affected")


def _grouped(measures: DataFrame, period_size: int | None) -> DataFrame:
    d = drop_all_null(measures, ["affected", "death"])
    p = F.col("year") if period_size is None else bin_period("year", period_size)
    d = not_null_keys(d.withColumn("period", p), ["country", "period", "hazard"])
    return d.groupBy("country", "period", "hazard")


def _impact_rows(agg: DataFrame) -> DataFrame:
    """log1p of the means → per-hazard z-scores (four-row broadcast) → sum."""
    logs = agg.select("*", log1p("_am").alias("_a_log"), log1p("_dm").alias("_d_log"))
    z = zscore(logs, {"_a_log": "_a_z", "_d_log": "_d_z"}, group=["hazard"])
    return z.withColumn("impact", F.col("_a_z") + F.col("_d_z")).drop(
        "_a_log", "_d_log", "_a_z", "_d_z", "_am", "_dm")


def _hazard_rows(measures: DataFrame, period_size: int | None, min_events: int,
                 total_measures: DataFrame | None = None) -> DataFrame:
    """Impact and total rows of each (country, period, hazard).

    With one measures input (the default) both builders aggregate the same
    groups, so one group-by serves both. With a separate totals input (the
    reference reads per-capita files for impacts and total-count files for
    totals) the two are aggregated apart and flagged, so the fold can tell
    a key that has only one of them.
    """
    if total_measures is None:
        agg = _grouped(measures, period_size).agg(
            F.avg("affected").alias("_am"), F.avg("death").alias("_dm"),
            F.count("year").alias("events"),
            F.coalesce(F.sum("affected"), F.lit(0.0)).alias("total_affected"),
            F.coalesce(F.sum("death"), F.lit(0.0)).alias("total_deaths"))
        rows = _impact_rows(having_min_events(agg, min_events))
        return rows.select("country", "period", "hazard", "impact", "total_affected",
                           "total_deaths", F.lit(1).alias("_mi"), F.lit(1).alias("_mt"))
    imp = _grouped(measures, period_size).agg(
        F.avg("affected").alias("_am"), F.avg("death").alias("_dm"),
        F.count("year").alias("events"))
    imp = _impact_rows(having_min_events(imp, min_events)).select(
        "country", "period", "hazard", "impact",
        F.lit(None).cast("double").alias("total_affected"),
        F.lit(None).cast("double").alias("total_deaths"),
        F.lit(1).alias("_mi"), F.lit(0).alias("_mt"))
    tot = _grouped(total_measures, period_size).agg(
        F.count("year").alias("events"),
        F.coalesce(F.sum("affected"), F.lit(0.0)).alias("total_affected"),
        F.coalesce(F.sum("death"), F.lit(0.0)).alias("total_deaths"))
    tot = having_min_events(tot, min_events).select(
        "country", "period", "hazard", F.lit(None).cast("double").alias("impact"),
        "total_affected", "total_deaths", F.lit(0).alias("_mi"), F.lit(1).alias("_mt"))
    return imp.unionByName(tot)


def _fold(hazard_rows: DataFrame, damage_long: DataFrame,
          binned: bool) -> DataFrame:
    """One group-by on (country, period) over impact/total rows and damage
    rows; returns the analysis columns before the derived ones."""
    m = hazard_rows.select("country", "period", "hazard", "impact",
                           "total_affected", "total_deaths",
                           F.lit(None).cast("string").alias("_dcol"),
                           F.lit(None).cast("double").alias("_dval"),
                           "_mi", "_mt")
    d = damage_long.select("country", "period",
                           F.lit(None).cast("string").alias("hazard"),
                           F.lit(None).cast("double").alias("impact"),
                           F.lit(None).cast("double").alias("total_affected"),
                           F.lit(None).cast("double").alias("total_deaths"),
                           "_dcol", "_dval", F.lit(0).alias("_mi"), F.lit(0).alias("_mt"))
    u = m.unionByName(d)
    has_i = F.sum("_mi") > 0
    has_t = F.sum("_mt") > 0
    aggs = [F.max(F.when(F.col("hazard") == h, F.col("impact"))).alias(f"{h}_impact")
            for h in HAZARDS]
    aggs += [F.avg("impact").alias("climate_impact_index"),
             F.when(has_i, F.count("impact")).alias("hazard_count"),
             F.when(has_t, F.sum("total_deaths")).alias("total_deaths"),
             F.when(has_t, F.sum("total_affected")).alias("total_affected"),
             has_i.alias("_has_i")]
    if binned:
        aggs += [F.avg(F.when(F.col("_dcol") == c, F.col("_dval"))).alias(f"_d_{c}")
                 for c in DAMAGE_COLUMNS]
    else:
        aggs.append(F.avg("_dval").alias("_damage"))
    out = u.groupBy("country", "period").agg(*aggs)
    if binned:
        out = out.where("_has_i").withColumn(
            "_damage", row_mean([f"_d_{c}" for c in DAMAGE_COLUMNS]))
    return out


def _finish(folded: DataFrame, sort: bool) -> DataFrame:
    # The global rebase reads the folded table twice (its minimum, then the
    # rows); column pruning would make those two different plans, so the
    # fold would run twice. It is written once instead.
    idx = rebase(stage(folded, "analysis-fold"), "climate_impact_index",
                 "impact_rebased")
    out = idx.select(
        "country", "period", *[f"{h}_impact" for h in HAZARDS],
        "climate_impact_index", "impact_rebased", "hazard_count",
        "total_deaths", "total_affected",
        value_or_zero_ratio("total_deaths", "total_affected").alias("resilience_rate"),
        fill_const("_damage", 0.0).alias("economic_damage_pct_gdp"))
    out = out.withColumn("resilience_per_100k", scale("resilience_rate", 100000))
    out = out.select(*ANALYSIS_COLUMNS)
    if sort:
        out = out.orderBy(F.col("country").asc_nulls_last(),
                          F.col("period").asc_nulls_last())
    return out


def _damage_long(damage_wide: DataFrame, period_size: int | None) -> DataFrame:
    long = melt(damage_wide, ["country", "year"], DAMAGE_COLUMNS, "_dcol", "_dval")
    p = F.col("year") if period_size is None else bin_period("year", period_size)
    return not_null_keys(long.withColumn("period", p), ["country", "period"])


def analysis_set_yearly(full_measures: DataFrame, damage_wide: DataFrame,
                        sort: bool = True, min_events: int = 1,
                        total_measures: DataFrame | None = None) -> DataFrame:
    """Impact ⟗ totals ⟗ damage on ``(country, period)``; rate 0 when
    nothing is affected; missing damage → 0. Rows without impacts keep a
    null index and null ``hazard_count``. ``total_measures`` (default: the
    same measures) feeds the totals builder."""
    rows = _hazard_rows(full_measures, None, min_events, total_measures)
    return _finish(_fold(rows, _damage_long(damage_wide, None), binned=False), sort)


def analysis_set_binned(inner_measures: DataFrame, damage_wide: DataFrame,
                        period_size: int = 5, sort: bool = True,
                        min_events: int = 1,
                        total_measures: DataFrame | None = None) -> DataFrame:
    """Binned impact ⟕ binned totals ⟕ binned damage (mean of the
    per-hazard means). ``total_measures`` (default: the same measures) feeds
    the totals builder."""
    rows = _hazard_rows(inner_measures, period_size, min_events, total_measures)
    folded = _fold(rows, _damage_long(damage_wide, period_size), binned=True)
    return _finish(folded, sort)
