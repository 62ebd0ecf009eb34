"""Projection and filters.

Plain ``select`` / ``where`` so Catalyst pushes them into the parquet scan
(``PushedFilters``) and prunes unread columns (``ReadSchema``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P1."""
    return df.withColumnsRenamed(mapping)


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Select and order columns."""
    return df.select(*cols)


def copy_col(df: DataFrame, src: str, dst: str) -> DataFrame:
    """``dst = src`` (e.g. ``period = year``)."""
    return df.withColumn(dst, F.col(src))


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: drop a row when *all* listed columns are missing."""
    return df.na.drop(how="all", subset=list(cols))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop a row when *any* listed column is missing."""
    return df.na.drop(how="any", subset=list(cols))


def filter_eq(df: DataFrame, c: str, value) -> DataFrame:
    """P7."""
    return df.where(F.col(c) == F.lit(value))


def split_by_period(df: DataFrame, period: str, cutoff: int,
                    train_inclusive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Temporal split: train ``< cutoff`` (or ``<= cutoff``), test the
    rest."""
    p = F.col(period)
    if train_inclusive:
        return df.where(p <= cutoff), df.where(p > cutoff)
    return df.where(p < cutoff), df.where(p >= cutoff)


def exclude_entities(df: DataFrame, c: str, names: Sequence[str]) -> DataFrame:
    """Exact-match NOT IN that keeps missing entities (the reference's
    ``~isin`` keeps them; SQL ``NOT IN`` would drop them)."""
    return df.where(~F.coalesce(F.col(c).isin(list(names)), F.lit(False)))


def having_min_events(agg: DataFrame, n: int = 1,
                      events: str = "events") -> DataFrame:
    """P10: keep groups with ``events >= n``."""
    return agg.where(F.col(events) >= n)


def having_more_than(agg: DataFrame, n: int = 1,
                     events: str = "events") -> DataFrame:
    """Keep groups with ``events > n``."""
    return agg.where(F.col(events) > n)


def drop_null(df: DataFrame, c: str) -> DataFrame:
    """Keep rows with a value."""
    return df.where(F.col(c).isNotNull())


def null_guard(df: DataFrame, c: str) -> DataFrame:
    """One-row frame: ``is_empty_or_all_null`` for a column."""
    return df.agg((F.count(c) == 0).alias("is_empty_or_all_null"),
                  F.count(c).alias("n_values"))


def period_bounds(df: DataFrame, period: str, lo: int, hi: int) -> DataFrame:
    """Selectable range ``[max(lo, min), min(hi, max)]`` as one row."""
    return df.agg(clamp(F.min(period), lo=lo).alias("min_period"),
                  clamp(F.max(period), hi=hi).alias("max_period"))
