"""Serving queries of the interactive page (C12–C16), computed for all
entities / periods at once; a page selection is a filter on the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (DOMINANT_LABELS, HAZARDS, PERIOD_CLAMP, RANK_PLACES,
                      SHARE_LABELS)
from ..functions.rowwise import row_argmax
from ..functions.scalar import risk_bucket
from ..operators.aggregate import feature_abs_mean, share_of_total
from ..operators.filters import drop_null, period_bounds
from ..operators.joins import attach_global_stats, map_labels
from ..operators.order import dense_rank, top_k
from ..operators.scale import rebase

IMPACT_COLS = [f"{h}_impact" for h in HAZARDS]


def rank_key(value: str, places: int | None) -> Column:
    """The value a rank orders by; ``places`` rounds it first so values
    equal up to float noise share a rank."""
    c = F.col(value)
    return c if places is None else F.round(c, places)


def period_ranking(analysis: DataFrame, period: str = "period",
                   value: str = "climate_impact_index",
                   span: int = 5, rank_places: int | None = RANK_PLACES) -> DataFrame:
    """C12 for every period: rebase within the period, dense rank (highest
    impact = 1), risk bucket, period end. Rows without a value are dropped
    (the reference cannot rank them)."""
    df = drop_null(analysis, value)
    df = rebase(df, value, "impact_rebased", scope=[period])
    df = df.withColumn("_key", rank_key("impact_rebased", rank_places))
    df = dense_rank(df, "_key", "impact_rank", scope=[period])
    return df.select(
        "country", period, (F.col(period) + (span - 1)).alias("period_end"),
        value, "impact_rebased", "impact_rank",
        risk_bucket("impact_rank").alias("risk_category"))


def selected_period(analysis: DataFrame, period: str = "period",
                    clamp: tuple[int, int] = PERIOD_CLAMP) -> DataFrame:
    """P16 + slider default: one row ``selected_period`` = the clamped max."""
    return period_bounds(analysis, period, *clamp).select(
        F.col("max_period").alias("selected_period"))


def period_ranking_selected(analysis: DataFrame, period: str = "period",
                            rank_places: int | None = RANK_PLACES) -> DataFrame:
    """C12 at the page's default selection, without a driver round trip:
    the one-row selection is broadcast beside the rows and filters them."""
    sel = selected_period(analysis, period)
    picked = (attach_global_stats(analysis, sel)
              .where(F.col(period) == F.col("selected_period"))
              .drop("selected_period"))
    return period_ranking(picked, period, rank_places=rank_places)


def dominant_hazard(analysis: DataFrame, entity: str = "country",
                    cols: Sequence[str] = IMPACT_COLS,
                    labels: dict[str, str] = DOMINANT_LABELS) -> DataFrame:
    """|mean| per hazard per entity, the largest one's label (a large
    negative mean wins too, because of the absolute value)."""
    means = feature_abs_mean(analysis, entity, cols)
    return means.withColumn(
        "hazard_prone", map_labels(row_argmax(list(cols)), labels))


def entity_trend(analysis: DataFrame, entity: str = "country",
                 period: str = "period",
                 value: str = "climate_impact_index") -> DataFrame:
    """C14 for every entity: its series with the index rebased within the
    entity, and the damage series beside it, in order of period."""
    df = rebase(analysis, value, "impact_rebased", scope=[entity])
    return df.select(entity, period, value, "impact_rebased",
                     "economic_damage_pct_gdp").orderBy(entity, period)


def hazard_share(totals: DataFrame, entity: str = "country",
                 labels: dict[str, str] = SHARE_LABELS) -> DataFrame:
    """Each hazard's share of the entity's total affected."""
    return share_of_total(totals, entity, labels, label="Hazard",
                          out="share")


def rank_scores(scores: DataFrame, value: str = "CLI", entity: str = "country",
                rank_places: int | None = RANK_PLACES) -> DataFrame:
    """Every row with a score, its global dense rank and risk bucket."""
    df = drop_null(scores, value).withColumn("_key", rank_key(value, rank_places))
    df = dense_rank(df, "_key", "CLI_rank")
    return df.select(entity, "CLI_rank", value,
                     risk_bucket("CLI_rank").alias("risk_category"))


def top_scores(ranked: DataFrame, k: int = 20, entity: str = "country") -> DataFrame:
    """O2 on C16: the k best ranks (ties by entity name)."""
    return top_k(ranked, [F.col("CLI_rank").asc(), F.col(entity).asc()], k)
