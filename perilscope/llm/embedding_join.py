"""Near duplicates among embeddings by an epsilon grid order join.

Two unit vectors with cosine ``c`` are ``sqrt(2 - 2c)`` apart, so the join looks
for pairs within that radius. The vectors are rotated onto their leading
principal dimensions, laid on a grid whose cells are as wide as the radius, and
sorted by cell. An interval of that sequence has a bounding box in the leading
dimensions; two intervals whose boxes are further apart than the radius hold no
link. The join starts with the whole sequence against itself, and recursively
splits both intervals and skips distant pairs: down to intervals of ``INTERVAL``
vectors as joins of small tables of boxes, below that inside the tasks, which
hold two intervals each. Pairs of leaf intervals are compared by their cosines.

No pair of vectors becomes a table row: a task returns, per vector, its number of
links and the least vector of its group in that task, so the edge table of the
components has at most one row per vector and pair of intervals. Vectors with
equal components are one node with a weight; a group of copies is never expanded.

Defined results of odd input: a null or zero vector, or one with a null, NaN or
infinite component, links with nothing; vectors of different lengths do not link;
repeated rows are vectors of their own that link with each other; rows with a
null ``vec_id`` count as links, but name a component only if no other row of it
has an id; an empty table gives no rows; other columns of the input are not read.
The cosine is that of the components as doubles; a value within 1e-12 of the
threshold is computed again by an exact sum before it decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .components import connected_components

THRESHOLD = 0.95
LEADING = 8         # principal dimensions of grid and boxes
INTERVAL = 4096     # vectors of an interval that is shipped to a task
FAN = 8             # intervals that the join of boxes splits one into
LEAF = 128          # vectors of an interval that is not split further
DOUBT = 1e-12


def _vectors(col: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, also where their squares leave a double's range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# -- principal dimensions and grid cells ---------------------------------------------

def _moments(batches):
    """Per vector length: count, sums and sums of products of a task's vectors."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        sizes = b["v"].value_lengths().to_numpy()
        for d in np.unique(sizes):
            x = unit(_vectors(b["v"].filter(pa.array(sizes == d))))
            x = np.hstack([np.ones((len(x), 1)), x])
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    for d, m in sums.items():
        i = np.arange(d + 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full((d + 1) ** 2, d)), pa.array(np.repeat(i, d + 1)),
             pa.array(np.tile(i, d + 1)), pa.array(m.ravel())], ["d", "i", "j", "m"])


def principal(nodes: DataFrame, leading: int = LEADING) -> dict[int, np.ndarray]:
    """Per vector length the leading principal directions ``(d, leading)`` of all
    vectors; only the ``(d + 1)**2`` sums of each length come to the driver."""
    rows = (nodes.select("v").mapInArrow(_moments, "d bigint, i bigint, j bigint, m double")
            .groupBy("d", "i", "j").agg(F.sum("m").alias("m")).collect())
    out: dict[int, np.ndarray] = {}
    for d in {r.d for r in rows}:
        m = np.zeros((d + 1, d + 1))
        for r in rows:
            if r.d == d:
                m[r.i, r.j] = r.m
        mean = m[0, 1:] / m[0, 0]
        _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[d] = vectors[:, ::-1][:, :leading]
    return out


def _place(axes: dict[int, np.ndarray], radius: float):
    """Adds each vector's coordinates on the principal axes and its grid cell."""
    def run(batches):
        for b in batches:
            sizes = b["v"].value_lengths().to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                at = unit(_vectors(part["v"])) @ axes[int(d)]
                cell = np.floor(at / radius).astype(np.int64)
                lists = [pa.ListArray.from_arrays(
                    pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]),
                    pa.array(x.ravel())) for x in (cell, at)]
                yield pa.RecordBatch.from_arrays(
                    [part["node"], part["v"], part["weight"], *lists],
                    ["node", "v", "weight", "cell", "at"])
    return run


def sequence(nodes: DataFrame, axes: dict[int, np.ndarray], radius: float) -> DataFrame:
    """Nodes with their place ``pos`` in the order of grid cells, per length ``d``.
    A task sorts one range of cells; a table of one row per task has the offsets."""
    placed = nodes.mapInArrow(_place(axes, radius),
                              "node bigint, v array<double>, weight bigint, "
                              "cell array<bigint>, at array<double>")
    placed = placed.withColumn("d", F.size("v"))
    laid = stage(placed.repartitionByRange("d", "cell", "node")
                 .sortWithinPartitions("d", "cell", "node")
                 .withColumn("part", F.spark_partition_id())
                 .withColumn("k", F.monotonically_increasing_id()), "join-order")
    # The ids of a task are consecutive from its least, in the order of its rows.
    parts = laid.groupBy("d", "part").agg(F.min("k").alias("k0"), F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy("d").orderBy("part")
              .rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("d", "part", "k0",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (laid.join(parts, ["d", "part"])
            .withColumn("pos", F.col("start") + F.col("k") - F.col("k0"))
            .select("d", "pos", "node", "v", "weight", "at"))


# -- pairs of intervals ------------------------------------------------------------------

def _apart(radius: float):
    """The boxes of the two sides are further apart than the radius."""
    gap = F.aggregate(
        F.zip_with(F.arrays_zip("a_low", "a_high"), F.arrays_zip("b_low", "b_high"),
                   lambda a, b: F.greatest(b["b_low"] - a["a_high"],
                                           a["a_low"] - b["b_high"], F.lit(0.0))),
        F.lit(0.0), lambda s, g: s + g * g)
    return gap > radius * radius * (1 + 1e-9)


def interval_pairs(placed: DataFrame, radius: float, interval: int = INTERVAL,
                   fan: int = FAN) -> DataFrame:
    """Pairs ``(d, a, b)``, a <= b, of sequence intervals that may hold a link, by
    joins from the whole sequence down, ``fan`` parts at a time."""
    lead = placed.select("d", F.floor(F.col("pos") / interval).alias("i"),
                         F.posexplode("at").alias("axis", "x"))
    bounds = lead.groupBy("d", "i", "axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    listed = F.sort_array(F.collect_list(F.struct("axis", "low", "high")))
    boxes = stage(bounds.groupBy("d", "i").agg(listed.alias("box")).select(
        "d", "i", F.col("box.low").alias("low"), F.col("box.high").alias("high")), "join-boxes")
    levels, top = [boxes], boxes.agg(F.max("i")).first()[0] or 0
    while top > 0:
        up = (levels[-1].select("d", F.floor(F.col("i") / fan).alias("i"),
                                F.posexplode(F.arrays_zip("low", "high")).alias("axis", "b"))
              .groupBy("d", "i", "axis").agg(F.min("b.low").alias("low"),
                                             F.max("b.high").alias("high"))
              .groupBy("d", "i").agg(listed.alias("box"))
              .select("d", "i", F.col("box.low").alias("low"), F.col("box.high").alias("high")))
        levels.append(up)
        top //= fan
    pairs = levels.pop().select("d", F.col("i").alias("a"), F.col("i").alias("b"))
    for level in reversed(levels):
        pairs = stage(pairs, "join-pairs")
        part = F.sequence(F.lit(0).cast("bigint"), F.lit(fan - 1).cast("bigint"))
        split = (pairs.withColumn("p", F.explode(part)).withColumn("q", F.explode(part))
                 .select("d", (F.col("a") * fan + F.col("p")).alias("a"),
                         (F.col("b") * fan + F.col("q")).alias("b")).where("a <= b"))
        for side in ("a", "b"):
            split = split.join(level.select("d", F.col("i").alias(side),
                                            F.col("low").alias(f"{side}_low"),
                                            F.col("high").alias(f"{side}_high")), ["d", side])
        pairs = split.where(~_apart(radius)).select("d", "a", "b")
    return pairs


# -- inside a task -------------------------------------------------------------------------

class _Groups:
    """Union-find over the rows of a task; a root is the least of its group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine by exact sums."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _linked(a: np.ndarray, b: np.ndarray, raw_a, raw_b, threshold: float) -> np.ndarray:
    cos = a @ b.T
    hit = cos >= threshold
    for i, j in zip(*np.nonzero(np.abs(cos - threshold) < DOUBT)):
        hit[i, j] = _exact(raw_a[i], raw_b[j]) >= threshold
    return hit


def _group(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray, groups: _Groups) -> None:
    """Join the groups of linked rows and columns: the least label travels along
    the links until nothing changes, so few unions are made."""
    r, c = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(r):
        return
    hit = hit[np.ix_(r, c)]
    rows, cols = rows[r], cols[c]
    lr = np.array([groups.root(x) for x in rows])
    lc = np.array([groups.root(x) for x in cols])
    most = len(groups.up)
    while True:
        nr = np.minimum(lr, np.where(hit, lc[None, :], most).min(axis=1))
        nc = np.minimum(lc, np.where(hit, nr[:, None], most).min(axis=0))
        if (nr == lr).all() and (nc == lc).all():
            break
        lr, lc = nr, nc
    for x, y in zip([*rows.tolist(), *cols.tolist()], [*lr.tolist(), *lc.tolist()]):
        groups.join(x, y)


def cell_links(threshold: float, leaf: int = LEAF):
    """Joins the two intervals of a cell (or one with itself): per vector with a
    link, its weighted number of links here and the least vector of its group."""
    radius2 = (2 - 2 * threshold) * (1 + 1e-9)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("pos", "ascending")])
        table = table.combine_chunks()
        raw = _vectors(table["v"].combine_chunks())
        at = _vectors(table["at"].combine_chunks())
        x, node = unit(raw), table["node"].to_numpy()
        weight, side = table["weight"].to_numpy(), table["side"].to_numpy()
        n, cut = len(node), int((side == 0).sum())
        links, groups = np.zeros(n, np.int64), _Groups(n)

        boxes: dict[tuple[int, int], tuple] = {}

        def box(lo, hi):
            if (lo, hi) not in boxes:
                boxes[lo, hi] = at[lo:hi].min(axis=0), at[lo:hi].max(axis=0)
            return boxes[lo, hi]

        todo = [((0, cut), (cut, n))] if cut < n else [((0, n), (0, n))]
        while todo:
            (a0, a1), (b0, b1) = todo.pop()
            (la, ha), (lb, hb) = box(a0, a1), box(b0, b1)
            gap = np.maximum(np.maximum(lb - ha, la - hb), 0)
            if gap @ gap > radius2:
                continue
            if max(a1 - a0, b1 - b0) > leaf:
                halves = [[(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)] if hi - lo > leaf
                          else [(lo, hi)] for lo, hi in ((a0, a1), (b0, b1))]
                same = (a0, a1) == (b0, b1)
                todo += [(p, q) for p in halves[0] for q in halves[1] if not same or p <= q]
                continue
            hit = _linked(x[a0:a1], x[b0:b1], raw[a0:a1], raw[b0:b1], threshold)
            if a0 == b0:
                np.fill_diagonal(hit, False)
                hit &= hit.T
                links[a0:a1] += hit @ weight[a0:a1]
            else:
                links[a0:a1] += hit @ weight[b0:b1]
                links[b0:b1] += weight[a0:a1] @ hit
            if hit.any():
                _group(hit, np.arange(a0, a1), np.arange(b0, b1), groups)
        some = np.flatnonzero(links)
        root = np.array([groups.root(i) for i in some.tolist()], np.int64)
        return pa.table({"node": node[some], "links": links[some], "to": node[root]})

    return run


# -- the operator -------------------------------------------------------------------------------

def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD, interval: int = INTERVAL) -> DataFrame:
    """One row per row of the input: ``vec_id, n_links, component_id, kept``."""
    radius = math.sqrt(2 - 2 * threshold)
    v = F.col("v")
    rows = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"),
                       F.col(vector).cast("array<double>").alias("v"))
    sound = (F.exists(v, lambda x: x != 0)
             & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.withColumn("v", F.when(sound, v))
    nodes = stage(rows.where("v IS NOT NULL").groupBy("v").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
        .withColumn("node", F.monotonically_increasing_id()), "join-nodes")

    placed = stage(sequence(nodes.select("node", "v", "weight"), principal(nodes), radius),
                   "join-placed")
    pairs = stage(interval_pairs(placed, radius, interval), "join-pairs")
    sides = pairs.select("d", "a", "b", F.col("a").alias("i"), F.lit(0).alias("side")).unionByName(
        pairs.where("a <> b").select("d", "a", "b", F.col("b").alias("i"), F.lit(1).alias("side")))
    cells = placed.withColumn("i", F.floor(F.col("pos") / interval)).join(sides, ["d", "i"])
    found = stage(cells.groupBy("d", "a", "b").applyInArrow(
        cell_links(threshold), "node bigint, links bigint, `to` bigint"), "join-links")

    groups = connected_components(
        found.select(F.col("node").alias("a"), F.col("to").alias("b")), "join-groups")
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = (nodes.select("node", "v", "weight", "low").join(count, "node", "left")
             .join(groups, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    name = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = known.join(name, "component").select(
        F.col("v").alias("u"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        "component_id")
    out = rows.join(known, F.col("v") == F.col("u"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("u").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
        .alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
