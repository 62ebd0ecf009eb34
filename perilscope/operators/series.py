"""Per-entity time-series windows.

The reference shifts and rolls over *rows* ordered by period within each
entity. A plain ``Window.partitionBy(entity)`` sends an entity's whole
history to one task, so one entity holding a third of the rows would
become one task. Here the rows are range-partitioned on ``(entity, period)``:
an entity's history spreads over as many partitions as its size asks for,
and every partition is one stretch of the sorted rows. The windows run on
``(entity, partition)``; what they miss are the rows just beyond the
partition's two ends. Those are exchanged at the boundaries: the last
``lookback`` and first ``lookahead`` rows of every partition form a small
table (a few rows per partition, whatever the data), in which each row finds
the partitions that it borders on, and is handed to them as a *halo* row. Halo
rows take part in the windows and are left out of the result.

A partition shorter than the lookback is wholly in that table, so a halo may
reach over several partitions. Rows of other entities in a halo do no harm:
the windows are keyed by the entity as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import stage


def _keys(entity: str | Sequence[str]) -> list[str]:
    return [entity] if isinstance(entity, str) else list(entity)


def _handed_on(ends: DataFrame, cols: list[str], rows: int, back: bool) -> DataFrame:
    """Rows of ``ends`` beside each partition within ``rows`` rows of them:
    later partitions whose first row is near (``back``), or earlier ones whose
    last row is. The window has no key; its rows are a few per partition."""
    w = Window.orderBy("_k")
    step = F.lead if back else F.lag
    edge = "_p0" if back else "_p1"
    targets = []
    for j in range(1, rows + 1):
        there = step(F.struct("_part", "_k", edge), j).over(w)
        targets.append(F.when((there["_k"] == there[edge])
                              & (there["_part"] != F.col("_part")), there["_part"]))
    return (ends.select(*cols, F.array_compact(F.array(*targets)).alias("_to"))
            .select(*cols, F.explode("_to").alias("_part")))


def with_series_columns(df: DataFrame, entity: str | Sequence[str],
                        period: str,
                        columns: Callable[[WindowSpec], dict[str, Column]],
                        lookback: int = 4, lookahead: int = 1,
                        partitions: int | None = None) -> DataFrame:
    """Add window columns computed over each entity's rows ordered by period.

    ``columns(w)`` returns ``{name: expression}`` built on the window spec
    ``w``; frames may reach at most ``lookback`` rows back and ``lookahead``
    rows forward. ``(entity, period)`` must identify a row. Without
    ``partitions`` Spark sizes the ranges. The sorted layout is written once
    to the shared folder, so both its uses see the same boundaries.
    """
    ents = _keys(entity)
    cols = df.columns
    order = [*ents, period]
    spread = (df.repartitionByRange(partitions, *order) if partitions
              else df.repartitionByRange(*order))
    # Ids of a partition are consecutive in the order of its rows.
    laid = stage(spread.sortWithinPartitions(*order)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_k", F.monotonically_increasing_id()), "series-layout")
    parts = F.broadcast(laid.groupBy("_part").agg(F.min("_k").alias("_p0"),
                                                  F.max("_k").alias("_p1")))
    own = laid.drop("_k").withColumn("_own", F.lit(True))
    # A partition's own two ends are always in the tables: they are the marks by
    # which its neighbours' rows recognise it.
    marks = (F.col("_k") == F.col("_p0")) | (F.col("_k") == F.col("_p1"))
    near = {True: (lookback, F.col("_p1") - F.col("_k") < lookback),
            False: (lookahead, F.col("_k") - F.col("_p0") < lookahead)}
    for back, (rows, close) in near.items():
        if rows:
            ends = laid.join(parts, "_part").where(close | marks)
            own = own.unionByName(_handed_on(ends, cols, rows, back)
                                  .withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*ents, "_part").orderBy(period)
    added = columns(w)
    out = own.select("*", *[e.alias(n) for n, e in added.items()])
    return out.where("_own").drop("_own", "_part")


# -- column builders over a window spec ------------------------------------

def lead1(v: str, w: WindowSpec) -> Column:
    """Next row's value (not next period's)."""
    return F.lead(v, 1).over(w)


def lag1(v: str, w: WindowSpec) -> Column:
    """Previous row's value."""
    return F.lag(v, 1).over(w)


def rolling_mean(v: str, w: WindowSpec, rows: int) -> Column:
    """Mean of the last ``rows`` rows, missing skipped, ≥ 1 value."""
    return F.avg(v).over(w.rowsBetween(-(rows - 1), 0))


def rolling_std(v: str, w: WindowSpec, rows: int) -> Column:
    """Sample std of the last ``rows`` rows; one value (or none) → 0."""
    return F.coalesce(F.stddev_samp(v).over(w.rowsBetween(-(rows - 1), 0)),
                      F.lit(0.0))


def rolling_trend(v: str, w: WindowSpec, rows: int) -> Column:
    """Least-squares slope over the last ``rows`` rows.

    Missing values are removed and the remaining ones re-numbered
    0..n−1 (period gaps are ignored); fewer than two values → 0.
    Closed form over ``rows`` lags of the same window, so it is one
    codegen'd expression: x of a value = number of present values before
    it in the frame, ``slope = (nΣxy − ΣxΣy) / (nΣx² − (Σx)²)``.
    """
    ys = [F.lag(v, j).over(w) if j else F.col(v)
          for j in range(rows - 1, -1, -1)]  # oldest first
    present = [y.isNotNull().cast("int") for y in ys]
    n = sum(present[1:], present[0])
    sy = F.lit(0.0)
    sxy = F.lit(0.0)
    x = F.lit(0)
    for y, p in zip(ys, present):
        sy = sy + F.coalesce(y, F.lit(0.0))
        sxy = sxy + F.coalesce(y, F.lit(0.0)) * x
        x = x + p
    nd = n.cast("double")
    sx = nd * (nd - 1) / 2
    sxx = (nd - 1) * nd * (2 * nd - 1) / 6
    slope = F.try_divide(nd * sxy - sx * sy, nd * sxx - sx * sx)
    return F.when(n >= 2, slope).otherwise(F.lit(0.0))


# -- row picks -------------------------------------------------------------

def latest_in(df: DataFrame, entity: str, period: str, lo: int, hi: int,
              entities: DataFrame | None = None) -> DataFrame:
    """Per entity, the row with the newest period in ``[lo, hi]``;
    only entities present in ``entities`` (e.g. seen in train) are kept.

    One partial aggregate of ``max(struct(period, row))`` per entity — no
    sort of the entity's rows, and a hot entity collapses map-side.
    """
    cols = [c for c in df.columns if c != entity]
    src = df.where(F.col(period).between(lo, hi) & F.col(entity).isNotNull())
    if entities is not None:
        src = src.join(entities.select(entity).distinct(), on=entity,
                       how="left_semi")
    picked = src.groupBy(entity).agg(
        F.max(F.struct(F.col(period).alias("_p"), *[F.col(c) for c in cols]))
        .alias("_row"))
    return picked.select(entity, *[F.col(f"_row.{c}").alias(c) for c in cols])


def deviation_from_mean(value: str, mean: str) -> Column:
    """Value minus its long-term (train) mean."""
    return F.col(value) - F.col(mean)
