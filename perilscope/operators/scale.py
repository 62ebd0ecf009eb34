"""Scalers and rebasing.

Statistics are one aggregate: a single row (global) or one row per group
of a small explicit list (e.g. the four hazards). That frame is broadcast
beside the rows, never computed with an un-partitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FLOAT64_EPS
from .joins import attach_global_stats, attach_group_stats


def _with_stats(df: DataFrame, stats: DataFrame,
                group: Sequence[str]) -> DataFrame:
    # Left to its size, the join would first deal the rows by group to a few tasks,
    # and adaptive execution keeps such a join: most of its partitions are empty.
    return (attach_group_stats(df, F.broadcast(stats), group) if group
            else attach_global_stats(df, stats))


def population_scale(var: Column, mean: Column, n: Column) -> Column:
    """Population std, or 1 for a constant column.

    A column counts as constant when its variance is within rounding noise
    of zero: ``var <= n·eps·var + (n·mean·eps)²`` (the scaler rule the
    reference relies on). No values → null.
    """
    eps = F.lit(FLOAT64_EPS)
    constant = var <= n * eps * var + F.pow(n * mean * eps, 2)
    return F.when(constant, F.lit(1.0)).otherwise(F.sqrt(var))


def moments(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Per group and column ``c`` a struct ``c`` of count, mean and ``m2`` (sum of
    squared deviations), which :func:`merge_moments` adds up."""
    return df.groupBy(*group).agg(*[F.struct(
        F.count(c).alias("n"), F.avg(c).alias("mean"),
        (F.var_pop(c) * F.count(c)).alias("m2")).alias(c) for c in cols])


def merge_moments(parts: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Moments of all rows from the moments of disjoint parts, by the pairwise
    update (no sums of squares that cancel). A group should have few parts: one
    per arrival or period, never one per row."""
    def join(a, p):
        n = a["n"] + p["n"]
        gap = p["mean"] - a["mean"]
        some = F.struct(n.alias("n"), (a["mean"] + gap * p["n"] / n).alias("mean"),
                        (a["m2"] + p["m2"] + gap * gap * a["n"] * p["n"] / n).alias("m2"))
        return F.when(p["n"] == 0, a).when(a["n"] == 0, p).otherwise(some)

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean"),
                    F.lit(None).cast("double").alias("m2"))
    return parts.groupBy(*group).agg(*[
        F.aggregate(F.sort_array(F.collect_list(c)), none, join).alias(c) for c in cols])


def zscore(df: DataFrame, cols: dict[str, str], group: Sequence[str] = (),
           fitted: DataFrame | None = None) -> DataFrame:
    """Z-score fit on all rows (within ``group``) with the population
    std; missing values are ignored by the fit and stay missing.

    ``cols`` maps input column → output column; ``fitted`` are :func:`moments`
    kept from before, instead of a pass over the rows.
    """
    group = list(group)
    if fitted is not None:
        stats = fitted.select(*group, *[x for i, c in enumerate(cols) for x in (
            F.col(c)["mean"].alias(f"_m{i}"), F.try_divide(F.col(c)["m2"], F.col(c)["n"]).alias(f"_v{i}"),
            F.col(c)["n"].alias(f"_n{i}"))])
    else:
        stats = df.groupBy(*group).agg(*[x for i, c in enumerate(cols) for x in (
            F.avg(c).alias(f"_m{i}"), F.var_pop(c).alias(f"_v{i}"),
            F.count(c).alias(f"_n{i}"))])
    stats = stats.select(*group, *[
        x for i in range(len(cols)) for x in (
            F.col(f"_m{i}"),
            population_scale(F.col(f"_v{i}"), F.col(f"_m{i}"),
                             F.col(f"_n{i}")).alias(f"_s{i}"))])
    out = _with_stats(df, stats, group)
    for i, (c, o) in enumerate(cols.items()):
        out = out.withColumn(o, F.try_divide(F.col(c) - F.col(f"_m{i}"), F.col(f"_s{i}")))
    return out.drop(*[f"_{p}{i}" for i in range(len(cols)) for p in "ms"])


def sample_stats(df: DataFrame, value: Column, prefix: str) -> DataFrame:
    """One-row mean and sample std of an expression, with the std rule
    ``std or 1``: 0 → 1, undefined (fewer than 2 rows) stays null."""
    s = df.agg(F.avg(value).alias(f"{prefix}_mean"),
               F.stddev_samp(value).alias(f"{prefix}_std"))
    return s.select(
        f"{prefix}_mean",
        F.when(F.col(f"{prefix}_std") == 0, F.lit(1.0))
        .otherwise(F.col(f"{prefix}_std")).alias(f"{prefix}_std"))


def zscore_train(df: DataFrame, value: Column, out: str, period: str,
                 cutoff: int, fit_value: Column | None = None) -> DataFrame:
    """Z-score fit on train rows (``period <= cutoff``) with the sample
    std, applied to every row."""
    train = df.where(F.col(period) <= cutoff)
    stats = sample_stats(train, fit_value if fit_value is not None else value,
                         f"_{out}")
    return (attach_global_stats(df, stats)
            .withColumn(out, (value - F.col(f"_{out}_mean")) / F.col(f"_{out}_std"))
            .drop(f"_{out}_mean", f"_{out}_std"))


def rebase(df: DataFrame, value: str, out: str,
           scope: Sequence[str] = ()) -> DataFrame:
    """``value - min(value)`` over the whole table or within ``scope``.

    Scoped minima are a partial aggregate joined back on the scope keys
    (a hot scope collapses map-side), not a window over the scope.
    """
    scope = list(scope)
    if not scope:
        mins = df.agg(F.min(value).alias("_min"))
        joined = attach_global_stats(df, mins)
    else:
        mins = df.groupBy(*scope).agg(F.min(value).alias("_min"))
        joined = df.join(mins, on=scope, how="left")
    return joined.withColumn(out, F.col(value) - F.col("_min")).drop("_min")
