"""Forecast features, composite index, prediction rows and their scores
(C7–C10).

* All series columns share one window spec (one sort per chunk, see
  :mod:`perilscope.operators.series`).
* Per-entity train means are one partial aggregate, joined back on the
  entity; global train statistics are one-row frames broadcast beside the
  rows. The same statistics frame serves C8 and C10 (the reference
  computes it twice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CLI_WEIGHTS, EXCLUDED_ENTITIES, FEATURES_IMPROVED, HAZARDS
from ..functions.rowwise import row_mean
from ..functions.scalar import fill_const, log1p, weighted_sum
from ..operators import series as S
from ..operators.aggregate import distinct_periods
from ..operators.filters import drop_null, exclude_entities
from ..operators.joins import attach_global_stats, semi_join_valid
from ..operators.order import column_medians
from ..session import stage

IMPACTS = [f"{h}_impact" for h in HAZARDS]
HUMAN_BURDEN_PARTS = ["log_total_affected", "log_total_death",
                      "log_total_affected_3yr_avg", "log_total_death_3yr_avg"]
PERSISTENCE_PARTS = ["impact_3yr_avg", "impact_lag1"]
COMPONENTS = ["human_burden", "persistence", "climate_intensity",
              "structural_vulnerability"]


def feature_table(analysis: DataFrame, cutoff: int,
                  excluded: Sequence[str] = EXCLUDED_ENTITIES,
                  entity: str = "country", period: str = "period",
                  partitions: int | None = None) -> DataFrame:
    """P9 → lead target, train entity means (J6), filled lag, logs,
    3-row means, 5-row slopes and std, long-run deviation."""
    df = exclude_entities(analysis, entity, excluded)
    df = df.withColumns({
        "log_total_affected": log1p(fill_const("total_affected", 0.0)),
        "log_total_death": log1p(fill_const("total_deaths", 0.0)),
    })

    def cols(w):
        return {
            "impact_rebased_next": S.lead1("impact_rebased", w),
            "_lag": S.lag1("impact_rebased", w),
            "total_affected_3yr_avg": fill_const(
                S.rolling_mean("total_affected", w, 3), 0.0),
            "total_death_3yr_avg": fill_const(
                S.rolling_mean("total_deaths", w, 3), 0.0),
            "impact_3yr_avg": S.rolling_mean("climate_impact_index", w, 3),
            "impact_trend_5yr": S.rolling_trend("climate_impact_index", w, 5),
            "absolute_impact_trend": S.rolling_trend("log_total_affected", w, 5),
            "impact_std_5yr": S.rolling_std("climate_impact_index", w, 5),
        }

    df = S.with_series_columns(df, entity, period, cols, lookback=4,
                               lookahead=1, partitions=partitions)
    train = df.where(F.col(period) <= cutoff)
    ent = (train.where(F.col(entity).isNotNull()).groupBy(entity)
           .agg(F.avg("impact_rebased").alias("_cm"),
                F.avg("climate_impact_index").alias("_cl")))
    glob = train.agg(F.avg("impact_rebased").alias("_gm"),
                     F.avg("climate_impact_index").alias("_gl"))
    df = attach_global_stats(df.join(ent, on=entity, how="left"), glob)
    df = df.withColumns({
        "country_mean_impact": F.coalesce("_cm", "_gm"),
        "country_long_term_mean": F.coalesce("_cl", "_gl"),
    })
    df = df.withColumns({
        "impact_lag1": F.coalesce("_lag", "country_mean_impact"),
        "log_total_affected_3yr_avg": log1p("total_affected_3yr_avg"),
        "log_total_death_3yr_avg": log1p("total_death_3yr_avg"),
        "country_recent_deviation": S.deviation_from_mean(
            "climate_impact_index", "country_long_term_mean"),
    })
    return df.drop("_cm", "_cl", "_gm", "_gl", "_lag")


def _component_inputs() -> dict[str, F.Column]:
    return {
        "human_burden": row_mean(HUMAN_BURDEN_PARTS),
        "persistence": row_mean(PERSISTENCE_PARTS),
        "climate_intensity": F.col("climate_impact_index"),
        "structural_vulnerability": F.col("country_mean_impact"),
    }


def component_stats(features: DataFrame, cutoff: int,
                    period: str = "period") -> DataFrame:
    """One row: train mean and sample std (``std or 1``) of each component's
    input, in one pass over the train rows."""
    train = features.where(F.col(period) <= cutoff)
    aggs = []
    for name, expr in _component_inputs().items():
        aggs += [F.avg(expr).alias(f"_{name}_m"),
                 F.stddev_samp(expr).alias(f"_{name}_s")]
    s = train.agg(*aggs)
    return s.select(*[x for name in COMPONENTS for x in (
        F.col(f"_{name}_m"),
        F.when(F.col(f"_{name}_s") == 0, F.lit(1.0))
        .otherwise(F.col(f"_{name}_s")).alias(f"_{name}_s"))])


def apply_components(df: DataFrame, stats: DataFrame,
                     weights: Sequence[float] = CLI_WEIGHTS) -> DataFrame:
    """Standardise the four components with ``stats`` and weight them."""
    out = attach_global_stats(df, stats)
    out = out.withColumns({
        name: (expr - F.col(f"_{name}_m")) / F.col(f"_{name}_s")
        for name, expr in _component_inputs().items()})
    out = out.withColumn("CLI", weighted_sum(COMPONENTS, weights))
    return out.drop(*[f"_{n}_{k}" for n in COMPONENTS for k in "ms"])


def composite_index(features: DataFrame, cutoff: int,
                    period: str = "period",
                    weights: Sequence[float] = CLI_WEIGHTS) -> DataFrame:
    """Human burden, persistence, climate intensity and structural
    vulnerability, each z-scored on train rows, then the weighted CLI."""
    return apply_components(features, component_stats(features, cutoff, period),
                            weights)


MEDIAN_FILLED = [f for f in FEATURES_IMPROVED
                 if f not in IMPACTS + ["climate_impact_index",
                                        "absolute_impact_trend"]]


def prediction_input(features: DataFrame, cutoff: int, lo: int, hi: int,
                     min_periods: int = 5, entity: str = "country",
                     period: str = "period", exact_median: bool = True) -> DataFrame:
    """Latest row in ``[lo, hi]`` per entity seen in train, entities with
    at least ``min_periods`` distinct train periods, then ordered
    imputation: hazards → 0; index → mean of the (zero-filled) hazards → 0;
    the absolute trend → 0; every other feature → its median over these
    rows (0 when entirely missing)."""
    train = features.where(F.col(period) <= cutoff)
    pred = S.latest_in(features, entity, period, lo, hi, entities=train)
    valid = (distinct_periods(train, entity, period)
             .where(F.col("n_periods") >= min_periods))
    pred = semi_join_valid(pred, valid, entity)
    pred = pred.withColumns({h: fill_const(h, 0.0) for h in IMPACTS})
    pred = pred.withColumn("climate_impact_index", F.coalesce(
        "climate_impact_index", row_mean(IMPACTS), F.lit(0.0)))
    pred = pred.withColumn("absolute_impact_trend",
                           fill_const("absolute_impact_trend", 0.0))
    meds = column_medians(pred, MEDIAN_FILLED, exact=exact_median)
    meds = meds.select(*[F.col(c).alias(f"_med_{c}") for c in MEDIAN_FILLED])
    pred = attach_global_stats(pred, meds)
    pred = pred.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}"), F.lit(0.0))
        for c in MEDIAN_FILLED})
    pred = pred.drop(*[f"_med_{c}" for c in MEDIAN_FILLED])
    # One row per entity. Written, because Catalyst derives constraints from the
    # nested fills: filters above them (complete cases, rows with a CLI) made it
    # derive so many that planning the forecast filled the driver's memory.
    return stage(pred, "prediction-input")


def score_latest(pred: DataFrame, stats: DataFrame,
                 excluded: Sequence[str] = EXCLUDED_ENTITIES,
                 entity: str = "country") -> DataFrame:
    """The C8 formulas on the imputed rows with the statistics of the
    un-imputed train rows; then P9 and rows with a CLI only."""
    scored = apply_components(pred, stats)
    return drop_null(exclude_entities(scored, entity, excluded), "CLI")
