"""Order-based operators that stay distributed: dense rank (W6), exact
quantiles / median (A12) and top-k (O2–O4).

A window with no ``partitionBy`` — or one whose partition is a hot key —
moves the whole input into one task. For ranks, the rows are
range-partitioned on ``(scope..., value, row hash)`` so a hot scope or a
hot value spans many partitions, each partition is ranked locally, and a
small per-partition summary gives the offset to add. The range layout is
written to the session's shared checkpoint folder before it is used twice,
so a recomputation after a lost executor cannot draw different range bounds
for the two uses.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage


def materialise(df: DataFrame, name: str = "order") -> DataFrame:
    """Cut lineage: write to the shared checkpoint folder, read back."""
    return stage(df, name)


def dense_rank(df: DataFrame, value: str, out: str,
               scope: Sequence[str] = (), descending: bool = True,
               num_partitions: int | None = None) -> DataFrame:
    """Dense rank of ``value`` within ``scope`` (highest = 1 when
    descending). Rows with a missing value get a null rank.

    The rows themselves are range-partitioned on ``(scope, value, row
    hash)``: the hash spreads a hot value over several partitions, so no
    partition exceeds its share. The layout (rows + partition id) is written
    once. A per-(partition, scope) summary — distinct count, first and last
    value — gives each partition its offset: the distinct values of earlier
    partitions minus the values shared across a partition boundary. The
    rank is that offset plus the local dense rank; no join back. The only
    window without a data key runs over the summary, which has at most one
    row per partition and scope.
    """
    scope = list(scope)
    v = F.col(value)
    vorder = v.desc_nulls_last() if descending else v.asc_nulls_last()
    hashable = [f.name for f in df.schema.fields
                if not isinstance(f.dataType, T.MapType)]
    tiebreak = F.xxhash64(*[F.col(f"`{c}`") for c in hashable])
    keys = [*[F.col(k) for k in scope], vorder, tiebreak]
    # Without an explicit count AQE sizes the range partitions (coalescing
    # keeps them contiguous, so partition ids stay in key order).
    spread = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    laid = materialise(spread.withColumn("_pid", F.spark_partition_id()),
                       "rank-layout")
    first = F.max(v) if descending else F.min(v)
    last = F.min(v) if descending else F.max(v)
    summary = (laid.groupBy("_pid", *scope)
               .agg(F.countDistinct(v).alias("_d"), first.alias("_first"),
                    last.alias("_last"))
               .where(F.col("_d") > 0))
    w = Window.partitionBy(*scope).orderBy("_pid")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.withColumn(
        "_overlap", (F.lag("_last").over(w) == F.col("_first")).cast("int"))
    offsets = summary.select(
        "_pid", *scope,
        (F.coalesce(F.sum("_d").over(before), F.lit(0))
         - F.coalesce(F.sum("_overlap").over(upto), F.lit(0))).alias("_off"))
    local = F.dense_rank().over(Window.partitionBy("_pid", *scope).orderBy(vorder))
    ranked = laid.withColumn("_loc", local).join(
        F.broadcast(offsets) if not scope else offsets, on=["_pid", *scope], how="left")
    return ranked.withColumn(
        out, F.when(v.isNotNull(), (F.col("_off") + F.col("_loc")).cast("long"))
    ).drop("_pid", "_loc", "_off")


def row_numbers(df: DataFrame, order: Sequence[Column], out: str = "ordinal") -> DataFrame:
    """Each row's place (from 1) in the order, as a column.

    ``order`` should name each row's place alone; rows that it ties get places
    next to each other. The rows are range-partitioned and sorted, written once,
    and numbered by their place in the partition plus the rows of the partitions
    before it. The window without a key runs over one row per partition.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = materialise(spread.withColumn("_pid", F.spark_partition_id())
                       .withColumn("_k", F.monotonically_increasing_id()), "ordinals")
    parts = laid.groupBy("_pid").agg(F.min("_k").alias("_k0"), F.count(F.lit(1)).alias("_m"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", "_k0", F.coalesce(F.sum("_m").over(before), F.lit(0))
                         .alias("_start"))
    return (laid.join(F.broadcast(parts), "_pid")
            .withColumn(out, F.col("_start") + F.col("_k") - F.col("_k0") + 1)
            .drop("_pid", "_k", "_k0", "_start"))


SKETCH_K = 2048
SKETCH_GRID = 1000


def _rank_error(k: int) -> float:
    """A KLL sketch of size ``k`` is within this normalised rank of the truth in
    about 99 % of cases. Only a first guess: every bracket is verified."""
    return 2.296 / k ** 0.9723


def exact_quantiles(df: DataFrame, value: str, qs: Sequence[float],
                    scope: Sequence[str] = (), k: int = SKETCH_K,
                    bracket_rows: int = 1_000_000) -> DataFrame:
    """Exact quantiles with linear interpolation (the pandas / DuckDB
    ``quantile_cont`` rule), missing values skipped; one row per scope with
    columns ``q0, q1, ...`` in ``qs`` order (nulls only for a scope without
    values; a null scope is a scope).

    The two order statistics of a quantile are searched within a *bracket* of
    values, at first the scope's whole range. While a bracket holds more than
    ``bracket_rows`` values, a mergeable KLL sketch of the values inside it
    proposes a narrower one, and a counting pass verifies it: if the ranks looked
    for lie inside, it replaces the old bracket, else the next proposal is four
    times as wide. So a bracket always holds its order statistics, whatever the
    sketches say. At the end the values inside the brackets are counted per
    distinct value (a hot value collapses map-side) and walked. No sort of the
    data, no group held whole; the driver sees how many scopes are not done.
    """
    keys = [f"_s{j}" for j in range(len(scope))] or ["_s0"]
    names = [F.col(c) for c in scope] or [F.lit(0)]
    narrow = stage(df.select(*[c.alias(n) for c, n in zip(names, keys)],
                             F.col(value).cast("double").alias("_v")), "quantile")
    v, some = F.col("_v"), range(len(qs))
    b = lambda i, field: F.col("_b")[i][field]

    def beside(state: DataFrame) -> DataFrame:
        """The values next to the brackets of their scope."""
        side = state.select(*[F.col(n).alias(f"_t{n}") for n in keys], "_b", "_open")
        side = side if scope else F.broadcast(side)         # one row
        on = [F.col(n).eqNullSafe(F.col(f"_t{n}")) for n in keys]
        both = narrow.join(side, on[0] if len(on) == 1 else [*on], "inner")
        return both.drop(*[f"_t{n}" for n in keys])

    def inside(i, low, high) -> Column:
        return (v >= low) & (v <= high)

    sizes = narrow.groupBy(*keys).agg(F.count(v).alias("_n"), F.min(v).alias("_min"),
                                      F.max(v).alias("_max"))
    pos = [(F.col("_n") - 1) * F.lit(float(q)) for q in qs]
    wide = lambda n: (n > bracket_rows)
    state = stage(sizes.where("_n > 0").select(*keys, F.array(*[F.struct(
        F.col("_min").alias("low"), F.col("_max").alias("high"), F.floor(p).alias("first"),
        F.ceil(p).alias("last"), (p - F.floor(p)).alias("part"),
        F.lit(0).cast("bigint").alias("below"), F.col("_n").alias("within"),
        F.lit(3 * _rank_error(k)).alias("error"), wide(F.col("_n")).alias("open"))
        for p in pos]).alias("_b")).withColumn("_open", F.exists("_b", lambda x: x["open"])),
        "quantile-brackets")
    done = state.where("NOT _open")
    state = state.where("_open")
    while state.where("_open").limit(1).count():
        drawn = (beside(state).groupBy(*keys, "_b").agg(*[
            F.kll_sketch_agg_double(F.when(inside(i, b(i, "low"), b(i, "high")), v), k)
            .alias(f"k{i}") for i in some]))

        # Sketches answer for constant ranks only: the values at a fixed grid.
        points = F.array(*[F.lit(j / SKETCH_GRID) for j in range(SKETCH_GRID + 1)])
        grids = drawn.select(*keys, "_b", *[
            F.kll_sketch_get_quantile_double(f"k{i}", points).alias(f"g{i}") for i in some])

        def at(i, of, sign, round_):
            share = (b(i, of) - b(i, "below")) / b(i, "within") + sign * b(i, "error")
            place = round_(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * SKETCH_GRID)
            return F.get(f"g{i}", place.cast("int"))
        proposed = grids.select(*keys, "_b", F.array(*[F.struct(
            F.when(b(i, "error") >= 0.5, b(i, "low"))
            .otherwise(at(i, "first", -1, F.floor)).alias("low"),
            F.when(b(i, "error") >= 0.5, b(i, "high"))
            .otherwise(at(i, "last", 1, F.ceil)).alias("high"))
            for i in some]).alias("_p"))
        proposed = stage(proposed.select(*keys, F.struct("_b", "_p").alias("_b"),
                                         F.lit(True).alias("_open")), "quantile-proposed")
        new = lambda i, field: F.col("_b")["_p"][i][field]
        old = lambda i, field: F.col("_b")["_b"][i][field]
        counted = beside(proposed).groupBy(*keys, "_b").agg(*[x for i in some for x in (
            F.count_if(v < new(i, "low")).alias(f"l{i}"),
            F.count_if(inside(i, new(i, "low"), new(i, "high"))).alias(f"n{i}"))])
        out = []
        for i in some:
            below, within = F.col(f"l{i}"), F.col(f"n{i}")
            holds = (old(i, "first") >= below) & (old(i, "last") < below + within)
            take = old(i, "open") & holds
            pick = lambda a, z: F.when(take, a).otherwise(z)  # noqa: B023,E731
            # A bracket of one value, or one that did not shrink, stays as it is.
            ended = (new(i, "low") == new(i, "high")) | (
                (within == old(i, "within")) & (old(i, "error") >= 0.5))
            out.append(F.struct(
                pick(new(i, "low"), old(i, "low")).alias("low"),
                pick(new(i, "high"), old(i, "high")).alias("high"),
                old(i, "first").alias("first"), old(i, "last").alias("last"),
                old(i, "part").alias("part"), pick(below, old(i, "below")).alias("below"),
                pick(within, old(i, "within")).alias("within"),
                F.when(holds & (within < old(i, "within")), old(i, "error"))
                .otherwise(4 * old(i, "error")).alias("error"),
                (old(i, "open") & ~F.when(holds, ~wide(within) | ended).otherwise(False))
                .alias("open")))
        state = stage(counted.select(*keys, F.array(*out).alias("_b")).withColumn(
            "_open", F.exists("_b", lambda x: x["open"])), "quantile-brackets")
        done = done.unionByName(state.where("NOT _open"))
        state = state.where("_open")
    done = stage(done, "quantile-done")
    picked = (beside(done).select(*keys, "_b", "_v", F.explode(F.array_compact(F.array(*[
        F.when(inside(i, b(i, "low"), b(i, "high")), F.lit(i)) for i in some]))).alias("_i"))
        .groupBy(*keys, "_i", "_v", F.col("_b")[F.col("_i")].alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c")))
    w = (Window.partitionBy(*keys, "_i").orderBy("_v")
         .rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("_x.below") + F.coalesce(F.sum("_c").over(w), F.lit(0))
    walk = picked.withColumn("_first", first)
    hit = lambda at: F.max(F.when((F.col("_first") <= F.col(f"_x.{at}")) & (
        F.col(f"_x.{at}") < F.col("_first") + F.col("_c")), v))
    found = (walk.groupBy(*keys, "_i").agg(hit("first").alias("_a"), hit("last").alias("_z"),
                                           F.max("_x.part").alias("_part"))
             .select(*keys, "_i", (F.col("_a") + (F.col("_z") - F.col("_a"))
                                   * F.col("_part")).alias("_q")))
    shown = [F.col(n).alias(c) for n, c in zip(keys, scope)]
    none = narrow.select(*keys, F.lit(None).cast("int").alias("_i"),
                         F.lit(None).cast("double").alias("_q")).distinct()
    if not scope:       # one row, also of an empty table
        none = narrow.sparkSession.range(1).select(
            F.lit(0).alias("_s0"), F.lit(None).cast("int").alias("_i"),
            F.lit(None).cast("double").alias("_q"))
    return found.unionByName(none).groupBy(*keys).agg(*[
        F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in some]
        ).select(*shown, *[f"q{i}" for i in some])


APPROX_ACCURACY = 10000
BRACKET_ROWS = 1_000_000


def column_summary(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                   accuracy: int = APPROX_ACCURACY,
                   bracket_rows: int = BRACKET_ROWS) -> list[dict]:
    """Per column ``count, mean, std, min, max`` and the exact
    interpolated quantiles ``qs`` (key ``q``, a list; None without values).

    Rows stay wide: one pass over the narrow projection takes the plain
    statistics and, per quantile, a bracket from ``percentile_approx``
    (rank error at most ``n / accuracy``); a second counts the values below
    and inside every bracket. A bracket that misses its order statistics is
    widened to the column's range, one with more than ``bracket_rows`` values
    is narrowed by a further approximate pass over its own values, until
    every bracket is small. Only the values inside brackets are then taken
    apart, counted per distinct value and walked. The driver sees a fixed
    number of figures per column and pass.
    """
    cols, qs = list(cols), list(qs)
    narrow = stage(df.select(*[F.col(c).cast("double").alias(f"c{i}")
                               for i, c in enumerate(cols)]), "summary")
    eps = 2.0 / accuracy
    share = [x for q in qs for x in (max(0.0, q - eps), min(1.0, q + eps))]
    first = narrow.agg(*[e for i in range(len(cols)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.avg(f"c{i}").alias(f"mean{i}"),
        F.stddev_samp(f"c{i}").alias(f"std{i}"), F.min(f"c{i}").alias(f"min{i}"),
        F.max(f"c{i}").alias(f"max{i}"),
        F.percentile_approx(f"c{i}", share, accuracy).alias(f"p{i}"))]).first()
    out, brackets = [], {}
    for i, c in enumerate(cols):
        out.append({"column": c, "count": first[f"n{i}"], "mean": first[f"mean{i}"],
                    "std": first[f"std{i}"], "min": first[f"min{i}"],
                    "max": first[f"max{i}"], "q": [None] * len(qs)})
        n = first[f"n{i}"]
        for j, q in enumerate(qs if n else []):
            pos = (n - 1) * q
            lo, hi = first[f"p{i}"][2 * j:2 * j + 2]
            if n <= 2 * accuracy:
                lo, hi = first[f"min{i}"], first[f"max{i}"]
            brackets[i, j] = {"lo": lo, "hi": hi, "k": int(pos), "up": math.ceil(pos),
                              "part": pos - int(pos)}
    if not brackets:
        return out
    inside = lambda i, b: (F.col(f"c{i}") >= b["lo"]) & (F.col(f"c{i}") <= b["hi"])
    while True:
        counts = narrow.agg(*[e for (i, j), b in brackets.items() for e in (
            F.count_if(F.col(f"c{i}") < b["lo"]).alias(f"b{i}_{j}"),
            F.count_if(inside(i, b)).alias(f"i{i}_{j}"))]).first()
        narrower = {}
        for (i, j), b in brackets.items():
            b["below"], b["in"] = counts[f"b{i}_{j}"], counts[f"i{i}_{j}"]
            if b["k"] < b["below"] or b["up"] >= b["below"] + b["in"]:
                b["lo"], b["hi"] = out[i]["min"], out[i]["max"]
                narrower[i, j] = None
            elif b["in"] > bracket_rows and b["lo"] < b["hi"]:
                at = [(x - b["below"]) / b["in"] for x in (b["k"], b["up"])]
                narrower[i, j] = [max(0.0, at[0] - eps), min(1.0, at[1] + eps)]
        asked = {k: v for k, v in narrower.items() if v is not None}
        if asked:
            row = narrow.agg(*[F.percentile_approx(
                F.when(inside(i, brackets[i, j]), F.col(f"c{i}")), v, accuracy)
                .alias(f"p{i}_{j}") for (i, j), v in asked.items()]).first()
            moved = False
            for i, j in asked:
                b, (lo, hi) = brackets[i, j], row[f"p{i}_{j}"]
                moved |= (lo, hi) != (b["lo"], b["hi"])
                b["lo"], b["hi"] = lo, hi
            if not moved and len(asked) == len(narrower):
                break       # a few distinct values, however many rows
        elif not narrower:
            break
    parts = F.array(*[F.when(inside(i, b), F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}").alias("v")))
        for (i, j), b in brackets.items()])
    counted = (narrow.select(F.explode(F.array_compact(parts)).alias("x")).select("x.*")
               .groupBy("i", "j", "v").agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("i", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    walk = counted.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    rank = lambda key: F.create_map(*[x for (i, j), b in brackets.items()
                                      for x in (F.lit(f"{i}_{j}"), F.lit(b[key] - b["below"]))]
                                    )[F.concat_ws("_", "i", "j")]
    hit = lambda key: F.max(F.when((F.col("before") <= rank(key)) & (
        rank(key) < F.col("before") + F.col("c")), F.col("v")))
    for r in walk.groupBy("i", "j").agg(hit("k").alias("a"), hit("up").alias("z")).collect():
        part = brackets[r["i"], r["j"]]["part"]
        out[r["i"]]["q"][r["j"]] = r["a"] + (r["z"] - r["a"]) * part
    return out


def column_medians(df: DataFrame, cols: Sequence[str],
                   exact: bool = True) -> DataFrame:
    """One-row frame of medians, one column per input column (see
    :func:`column_summary`); ``exact=False`` uses ``percentile_approx``
    instead (one pass, bounded memory).
    """
    cols = list(cols)
    if not exact:
        return df.agg(*[F.percentile_approx(c, 0.5).cast("double").alias(c)
                        for c in cols])
    found = column_summary(df, cols, [0.5])
    return df.sparkSession.range(1).select(
        *[F.lit(x["q"][0]).cast("double").alias(x["column"]) for x in found])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``orderBy(...).limit(k)`` → TakeOrderedAndProject, a
    distributed top-k (each task keeps k rows, the driver merges k × tasks)."""
    return df.orderBy(*order).limit(k)
