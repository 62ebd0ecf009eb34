"""Reshaping: melt (U2), union of rows (U1), named totals → rows (U3) and
the hazard merge (J3).

J3 in the reference is a chain of three full outer joins on
``(country, period)``. The same result comes from one union of long rows and
one group-by with a value per hazard of an explicit list: a single shuffle instead
of three, and no join-order question. It counts the rows of each cell: a key that a
hazard holds more than once is an error, or, when asked for, gives one row per
combination, as the joins would.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str],
         var: str = "variable", val: str = "value") -> DataFrame:
    """Wide → long; missing values are kept as rows."""
    return df.unpivot(list(ids), list(values), var, val)


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def dict_to_rows(df: DataFrame, ids: Sequence[str], named: dict[str, str],
                 var: str, val: str) -> DataFrame:
    """Named columns → ``(name, value)`` rows; ``named`` maps
    label → column."""
    renamed = df.select(*ids, *[F.col(c).alias(lab) for lab, c in named.items()])
    return renamed.unpivot(list(ids), list(named), var, val)


def merge_long(long: DataFrame, keys: Sequence[str], hazard: str,
               hazards: Sequence[str], values: dict[str, str],
               spelling: dict[str, str] | None = None,
               repeats: str = "raise") -> DataFrame:
    """Long ``(keys, hazard, value...)`` rows → one wide row per key.

    ``values`` maps a value column → output name pattern with ``{h}`` for
    the hazard name (``spelling`` may rename a hazard in output names). The
    pivot keeps a key when any hazard has a row, as the outer chain does; rows
    of a null key belong together.

    ``repeats`` says what happens to a key with several rows of one hazard:
    ``"raise"`` fails when the row is computed (the count of each cell is part
    of the same aggregate), ``"multiply"`` returns a row for every combination
    of the hazards' rows, which is what the chain of joins returns.
    """
    spelling = spelling or {}
    names = list(hazards)
    label = lambda h, v: values[v].format(h=spelling.get(h, h))
    if repeats == "multiply":
        wide = long.groupBy(*keys).pivot(hazard, names).agg(
            F.collect_list(F.struct(*values)).alias("_rows"), F.lit(0).alias("_pad"))
        for h in names:
            wide = wide.withColumn(h, F.explode_outer(f"`{h}__rows`"))
        return wide.select(*keys, *[F.col(f"`{h}`.`{v}`").alias(label(h, v))
                                    for h in names for v in values])
    if repeats != "raise":
        raise ValueError(f"repeats must be 'raise' or 'multiply', not {repeats!r}")
    # One aggregate per cell: a pivot would first group by the hazard as well, and a
    # task would hold both tables of groups.
    cell = {h: F.col(hazard) == F.lit(h) for h in names}
    wide = long.groupBy(*keys).agg(*[x for h in names for x in (
        *[F.max(F.when(cell[h], F.col(v))).alias(f"{h}_{v}") for v in values],
        F.count_if(cell[h]).alias(f"{h}__rows"))])

    def once(h: str, v: str):
        key = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        return F.when(F.col(f"`{h}__rows`") > 1, F.raise_error(F.concat(
            F.lit(f"more than one row of {h} for "), key))).otherwise(F.col(f"`{h}_{v}`"))

    return wide.select(*keys, *[once(h, v).alias(label(h, v)) for h in names for v in values])


def merge_hazards(frames: dict[str, DataFrame], keys: Sequence[str],
                  values: dict[str, str], repeats: str = "raise") -> DataFrame:
    """J3 for per-hazard frames (the reference's shape): tag each frame with
    its hazard, union, pivot. ``values`` and ``repeats`` as in
    :func:`merge_long`, and each frame carries its value columns under the plain
    names."""
    long = union_rows([f.select(*keys, *values, F.lit(h).alias("_hazard"))
                       for h, f in frames.items()])
    return merge_long(long, keys, "_hazard", list(frames), values, repeats=repeats)
