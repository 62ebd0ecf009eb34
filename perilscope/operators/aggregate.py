"""Aggregations (A1–A12, A20, A21) and profiling counters.

Every group-by here is algebraic (sum / count / avg / min / max /
stddev), so Spark runs a partial aggregate before the shuffle: a key that
holds a third of all rows collapses to one row per map task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import column_summary
from .reshape import dict_to_rows


def not_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group-bys drop rows with a missing key, as the reference's do."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def agg_mean(df: DataFrame, keys: Sequence[str], year: str = "year",
             measures: Sequence[str] = ("affected", "death")) -> DataFrame:
    """A1: mean of each measure and ``events = count(year)`` per group."""
    return (not_null_keys(df, keys).groupBy(*keys)
            .agg(*[F.avg(m).alias(m) for m in measures],
                 F.count(year).alias("events")))


def agg_total(df: DataFrame, keys: Sequence[str], year: str = "year",
              measures: dict[str, str] | None = None) -> DataFrame:
    """A2: sums per group; a group whose values are all missing sums to 0.

    ``measures`` maps input column → output name.
    """
    measures = measures or {"death": "total_deaths", "affected": "total_affected"}
    return (not_null_keys(df, keys).groupBy(*keys)
            .agg(F.count(year).alias("events"),
                 *[F.coalesce(F.sum(m), F.lit(0.0)).alias(out)
                   for m, out in measures.items()]))


def agg_mean_cols(df: DataFrame, keys: Sequence[str],
                  cols: Sequence[str]) -> DataFrame:
    """A3: mean of several columns per group."""
    return not_null_keys(df, keys).groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in cols])


def entity_mean(df: DataFrame, entity: str, period: str, value: str,
                cutoff: int | None = None, out: str | None = None) -> DataFrame:
    """A4: per-entity mean over train periods (``period <= cutoff``)."""
    src = df if cutoff is None else df.where(F.col(period) <= cutoff)
    return not_null_keys(src, [entity]).groupBy(entity).agg(
        F.avg(value).alias(out or value))


def global_stats(df: DataFrame, value: str | Column,
                 prefix: str = "") -> DataFrame:
    """A5: one-row frame with mean, sample std and min of a value."""
    v = F.col(value) if isinstance(value, str) else value
    return df.agg(F.avg(v).alias(f"{prefix}mean"),
                  F.stddev_samp(v).alias(f"{prefix}std"),
                  F.min(v).alias(f"{prefix}min"))


def distinct_periods(df: DataFrame, entity: str, period: str,
                     out: str = "n_periods") -> DataFrame:
    """Number of distinct periods per entity."""
    return (not_null_keys(df, [entity]).groupBy(entity)
            .agg(F.countDistinct(period).alias(out)))


def distinct_sorted(df: DataFrame, c: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def value_counts(df: DataFrame, c: str, dropna: bool = True) -> DataFrame:
    """Frequency of each value, most frequent first (missing values not
    counted unless ``dropna=False``)."""
    src = df.where(F.col(c).isNotNull()) if dropna else df
    return (src.groupBy(c).agg(F.count("*").alias("count"))
            .orderBy(F.col("count").desc(), F.col(c).asc()))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max per numeric column, typed
    and exact (``DataFrame.summary`` returns strings and approximate
    quartiles). Long form: one row per column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    rows = [(x["column"], x["count"], x["mean"], x["std"], x["min"], x["max"], *x["q"])
            for x in column_summary(df, cols, [0.25, 0.5, 0.75])]
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, "
              "max double, q25 double, q50 double, q75 double")


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A10: missing values per column, long form ``(column, nulls)``."""
    cols = list(cols) if cols is not None else df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "nulls")


def profile_shape(df: DataFrame, period: str, entity: str) -> DataFrame:
    """Row count, column count, period range, distinct entities and
    periods in one pass."""
    return df.agg(F.count("*").alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_cols"),
                  F.min(period).alias("min_period"),
                  F.max(period).alias("max_period"),
                  F.countDistinct(entity).alias("n_entities"),
                  F.countDistinct(period).alias("n_periods"))


def share_of_total(df: DataFrame, entity: str, cols: dict[str, str],
                   label: str = "hazard", out: str = "share") -> DataFrame:
    """Per entity, each column's sum divided by the sum of all of them
    (0/0 → null). ``cols`` maps label → column. Computed for all entities
    in one aggregate; the division stays row-wise."""
    labels = list(cols)
    sums = not_null_keys(df, [entity]).groupBy(entity).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(lab) for lab, c in cols.items()])
    total = sums.select(entity, *labels, sum(
        (F.col(f"`{lab}`") for lab in labels), F.lit(0.0)).alias("_total"))
    long = dict_to_rows(total, [entity, "_total"], {lab: lab for lab in labels},
                        label, "_sum")
    return long.select(entity, label, F.col("_sum").alias("contribution"),
                       F.try_divide(F.col("_sum"), F.col("_total")).alias(out))


def feature_abs_mean(df: DataFrame, entity: str,
                     cols: Sequence[str]) -> DataFrame:
    """Mean per entity, then absolute value."""
    return not_null_keys(df, [entity]).groupBy(entity).agg(
        *[F.abs(F.avg(c)).alias(c) for c in cols])
