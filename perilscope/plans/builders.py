"""The two builders and their merges.

The reference runs each builder once per hazard and then chains full outer
joins. Here the hazard is a key column: one group-by serves all hazards,
the scaler's statistics are one row per hazard (a frame bounded by the
hazard list, broadcast), and one pivot produces the wide table. A single
hazard's frame (no hazard column) goes through the same code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DAMAGE_COLUMNS, HAZARDS, TOTAL_NAMES, TOTAL_ORDER
from ..functions.rowwise import row_count_nonnull, row_mean, row_sum_strict
from ..functions.scalar import bin_period, fill_const, log1p
from ..operators.aggregate import agg_mean, agg_mean_cols, agg_total
from ..operators.filters import drop_all_null, having_min_events, having_more_than
from ..operators.reshape import melt, merge_long
from ..operators.scale import rebase, zscore

IMPACT_COLS = [f"{h}_impact" for h in HAZARDS]


def _with_period(df: DataFrame, year: str, period_size: int | None) -> DataFrame:
    p = F.col(year) if period_size is None else bin_period(year, period_size)
    return df.withColumn("period", p)


def hazard_impact(measures: DataFrame, hazard: str | None = "hazard",
                  name: str | None = None, period_size: int | None = None,
                  min_events: int = 1, strict: bool = False,
                  entity: str = "country", year: str = "year",
                  affected: str = "affected", death: str = "death") -> DataFrame:
    """Mean → log1p → z-score (population std, per hazard) → sum.

    ``measures`` has ``entity, year, affected, death`` (+ ``hazard`` when
    several hazards are processed at once). Output: ``entity, period,
    [hazard,] impact`` — or ``<name>_impact`` for a single-hazard frame.
    The impact is missing when either measure is missing. ``strict`` keeps
    groups with more than ``min_events`` rows instead of at least.
    """
    keys = [entity, "period"] + ([hazard] if hazard else [])
    agg = impact_logs(measures, keys, period_size, min_events, strict, year, affected, death)
    return impact_of_logs(agg, keys, [hazard] if hazard else [],
                          "impact" if hazard else f"{name}_impact")


def impact_logs(measures: DataFrame, keys: Sequence[str], period_size: int | None = None,
                min_events: int = 1, strict: bool = False, year: str = "year",
                affected: str = "affected", death: str = "death") -> DataFrame:
    """C1 up to the logarithms of a group's means, ``_a_log`` and ``_d_log``: what
    one period contributes, whatever the other periods hold."""
    d = drop_all_null(measures, [affected, death])
    d = _with_period(d, year, period_size)
    agg = agg_mean(d, list(keys), year, [affected, death])
    agg = (having_more_than(agg, min_events) if strict
           else having_min_events(agg, min_events))
    return agg.select(*keys, log1p(affected).alias("_a_log"),
                      log1p(death).alias("_d_log"))


def impact_of_logs(logs: DataFrame, keys: Sequence[str], group: Sequence[str],
                   out: str = "impact", fitted: DataFrame | None = None) -> DataFrame:
    """C1 from the logarithms: z-scores within ``group``, added up. ``fitted``:
    moments kept from before (:func:`~perilscope.operators.scale.moments`)."""
    z = zscore(logs, {"_a_log": "_a_z", "_d_log": "_d_z"}, group=group, fitted=fitted)
    return z.select(*keys, (F.col("_a_z") + F.col("_d_z")).alias(out))


def hazard_total(measures: DataFrame, hazard: str | None = "hazard",
                 name: str | None = None, period_size: int | None = None,
                 min_events: int = 1, entity: str = "country",
                 year: str = "year", affected: str = "affected",
                 death: str = "death") -> DataFrame:
    """Per-group sums (all-missing → 0), then the event filter.

    Output: ``entity, period, [hazard,] total_affected, total_deaths`` — or
    ``<name>_total_affected, <name>_total_deaths`` for a single frame.
    """
    d = drop_all_null(measures, [affected, death])
    d = _with_period(d, year, period_size)
    keys = [entity, "period"] + ([hazard] if hazard else [])
    agg = agg_total(d, keys, year, {death: "total_deaths",
                                    affected: "total_affected"})
    agg = having_min_events(agg, min_events)
    if hazard:
        return agg.select(*keys, "total_affected", "total_deaths")
    return agg.select(*keys,
                      F.col("total_affected").alias(f"{name}_total_affected"),
                      F.col("total_deaths").alias(f"{name}_total_deaths"))


def merge_impacts(impact_long: DataFrame, hazards: Sequence[str] = HAZARDS,
                  entity: str = "country") -> DataFrame:
    """J3 for impacts: one wide row per ``(entity, period)``."""
    return merge_long(impact_long, [entity, "period"], "hazard", hazards,
                      {"impact": "{h}_impact"})


def merge_totals(total_long: DataFrame, hazards: Sequence[str] = TOTAL_ORDER,
                 entity: str = "country") -> DataFrame:
    """J3 for totals (storm spelled ``storm``)."""
    return merge_long(total_long, [entity, "period"], "hazard", hazards,
                      {"total_affected": "{h}_total_affected",
                       "total_deaths": "{h}_total_deaths"},
                      spelling=TOTAL_NAMES)


def impact_index(wide: DataFrame, impact_cols: Sequence[str] = IMPACT_COLS) -> DataFrame:
    """index = mean of present impacts, hazard count, global rebase."""
    cols = list(impact_cols)
    out = wide.select("*", row_mean(cols).alias("climate_impact_index"),
                      row_count_nonnull(cols).alias("hazard_count"))
    return rebase(out, "climate_impact_index", "impact_rebased")


def totals_table(wide: DataFrame, hazards: Sequence[str] = TOTAL_ORDER) -> DataFrame:
    """C4: zero-fill the per-hazard totals, then add them up (``+`` after the
    fill, so the strict and the skip-missing sums agree)."""
    names = [TOTAL_NAMES[h] for h in hazards]
    value_cols = [f"{n}_{k}" for n in names for k in ("total_affected", "total_deaths")]
    filled = wide.select(*[c for c in wide.columns if c not in value_cols],
                         *[fill_const(c, 0.0).alias(c) for c in value_cols])
    return filled.select(
        "*",
        row_sum_strict([f"{n}_total_deaths" for n in names]).alias("total_deaths"),
        row_sum_strict([f"{n}_total_affected" for n in names]).alias("total_affected"))


def damage_yearly(wide: DataFrame, entity: str = "country", year: str = "year",
                  cols: Sequence[str] = DAMAGE_COLUMNS) -> DataFrame:
    """Melt, then the mean of all long rows per ``(entity, period)``."""
    long = melt(wide, [entity, year], list(cols), "hazard",
                "economic_damage_pct_gdp")
    return (long.where(F.col(entity).isNotNull() & F.col(year).isNotNull())
            .groupBy(entity, F.col(year).alias("period"))
            .agg(F.avg("economic_damage_pct_gdp").alias("economic_damage_pct_gdp")))


def damage_binned(wide: DataFrame, period_size: int = 5,
                  entity: str = "country", year: str = "year",
                  cols: Sequence[str] = DAMAGE_COLUMNS) -> DataFrame:
    """Per-hazard mean within the bin, then the mean of those means
    (differs from C5a when missingness is uneven)."""
    binned = _with_period(wide, year, period_size)
    per = agg_mean_cols(binned, [entity, "period"], list(cols))
    return per.select(entity, "period",
                      row_mean(list(cols)).alias("economic_damage_pct_gdp"))
