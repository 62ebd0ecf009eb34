"""Joins (J1–J10).

Physical strategy is left to Catalyst/AQE (broadcast by its size estimate,
otherwise sort-merge with skew splitting). Only one-row statistics frames are
broadcast explicitly: their size is fixed by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 how: str) -> DataFrame:
    """Equi-join on same-named keys; outer joins coalesce the keys.

    Null keys never match (SQL semantics); builders drop null keys first,
    which is also what the reference's group-bys do.
    """
    return left.join(right, on=list(keys), how=how)


def join_full(left: DataFrame, right: DataFrame,
              keys: Sequence[str] = ("country", "year")) -> DataFrame:
    """Full outer join of two measures."""
    return join_on_keys(left, right, keys, "full")


def join_inner(left: DataFrame, right: DataFrame,
               keys: Sequence[str] = ("country", "year")) -> DataFrame:
    """Inner join of two measures (binned pipeline)."""
    return join_on_keys(left, right, keys, "inner")


def chain_join(frames: Sequence[DataFrame], keys: Sequence[str],
               how: str) -> DataFrame:
    """Left-deep chain of joins on the same keys."""
    return reduce(lambda a, b: join_on_keys(a, b, keys, how), frames)


def assemble_full(impact: DataFrame, total: DataFrame, econ: DataFrame,
                  keys: Sequence[str] = ("country", "period")) -> DataFrame:
    """Continuous set, full outer chain."""
    return chain_join([impact, total, econ], keys, "full")


def assemble_left(impact: DataFrame, total: DataFrame, econ: DataFrame,
                  keys: Sequence[str] = ("country", "period")) -> DataFrame:
    """Binned set, left outer chain."""
    return chain_join([impact, total, econ], keys, "left")


def attach_global_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Put a one-row statistics frame beside every row.

    The stats frame comes out of a global aggregate, so it has exactly one
    row: broadcasting it is bounded and keeps ``df``'s partitioning.
    """
    return df.crossJoin(F.broadcast(stats))


def attach_group_stats(df: DataFrame, stats: DataFrame,
                       keys: Sequence[str]) -> DataFrame:
    """J10 per group: one row of statistics per group, joined by size: Spark
    broadcasts it below its threshold (the four hazards always are) and
    shuffles otherwise."""
    return df.join(stats, on=list(keys), how="left")


def lookup(df: DataFrame, stats: DataFrame, key: str | Sequence[str],
           value: str, out: str, default: Column | None = None) -> DataFrame:
    """Map entity → statistic; unseen entities get ``default``.

    ``stats`` has one row per entity; Catalyst broadcasts it when its size
    estimate is under the threshold and shuffles otherwise.
    """
    keys = [key] if isinstance(key, str) else list(key)
    s = stats.select(*keys, F.col(value).alias(out))
    joined = df.join(s, on=keys, how="left")
    if default is not None:
        joined = joined.withColumn(out, F.coalesce(F.col(out), default))
    return joined


def map_labels(c: Column | str, mapping: dict[str, str]) -> Column:
    """Code → label; unmapped → null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return m[F.col(c) if isinstance(c, str) else c]


def semi_join_valid(df: DataFrame, valid: DataFrame,
                    key: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key is in ``valid``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(valid.select(*keys), on=keys, how="left_semi")


def key_coverage(a: DataFrame, b: DataFrame,
                 keys: Sequence[str]) -> DataFrame:
    """J9 (re-aimed by key): how many keys are in both, left only, right only.

    Distinct keys per side first, then one full join of the key sets.
    """
    ka = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    kb = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    j = ka.join(kb, on=list(keys), how="full")
    return j.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"),
        F.count_if(F.col("_b").isNull()).alias("left_only"),
        F.count_if(F.col("_a").isNull()).alias("right_only"))
