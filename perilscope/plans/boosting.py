"""Tree searches in tasks (M5) and regularised gradient boosting (M3, M4).

Spark's learners run several jobs per tree level, so a search of tens of draws
in three folds is hundreds of thousands of small jobs; its boosting has no leaf
penalties. Here a fit is one task: the (draws, fold) pairs of a search are the
rows of a table that Spark deals to its executors, and every task grows its
trees from histograms of the training rows, which it gets as a broadcast. That
broadcast is bounded by ``FIT_ROWS``, a parameter. The forecast's search leaves no
row out: a larger training table goes to Spark's forests
(:func:`perilscope.plans.model.random_search_cv`). The learners of the bake-off
take the rows with the least hash of their key (:func:`training_sample`). Draws
share fits: those that differ in
``n_estimators`` alone, whose scores are taken after each number of trees asked
for, and forests that differ in ``max_depth`` as well, whose trees are cut.

Boosting: squared error; per leaf with gradient sum G and row count H the value
is ``-T(G) / (H + reg_lambda)`` with soft threshold ``T`` at ``reg_alpha``; a split
must gain more than ``gamma``. With all three 0 this is plain boosting. A forest
grows the same trees on bootstrapped rows, each node on features of its own.
A fitted model is a :class:`~perilscope.plans.nodes.NodeTable`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .nodes import DEEPEST, NodeTable

FIT_ROWS = 200_000
BINS = 64
CELLS = 1 << 20         # histogram cells of a level that are held at once
FEW_CELLS = 1 << 15     # a level of so few cells is one histogram of all bins

# Names of the two learners' parameters, and their values where a draw is silent.
FOREST_DEFAULTS = {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1,
                   "max_features": "all"}
DEFAULTS = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "min_rows": 1,
            "subsample": 1.0, "colsample_bytree": 1.0, "gamma": 0.0, "reg_alpha": 0.0,
            "reg_lambda": 0.0}
SAME = {"min_samples_leaf": "min_rows", "min_child_weight": "min_rows"}


def parameters(draw: dict) -> dict:
    return DEFAULTS | {SAME.get(k, k): v for k, v in draw.items()}


def training_table(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None,
                   keys: Sequence[str] = ("country", "period")):
    """``(x, y, fold)`` arrays of all rows, in the order of the keys: for tables that
    every task can hold."""
    table = df.orderBy(*[F.asc_nulls_last(k) for k in keys]).select(
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)],
        F.col(target).cast("double").alias("y"),
        (F.col(fold) if fold else F.lit(0)).cast("long").alias("f")).toArrow()
    *x, y, f = (c.to_numpy() for c in table.columns)
    return np.column_stack(x).astype(np.float64), y.astype(np.float64), f.astype(np.int64)


def training_sample(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None,
                    keys: Sequence[str] = ("country", "period"), rows: int = FIT_ROWS):
    """``(x, y, fold)`` arrays of at most ``rows`` rows, those with the least hash
    of their key, in the order of the keys."""
    picked = df.orderBy(F.xxhash64(*keys), *keys).limit(rows)
    return training_table(picked, features, target, fold, keys)


# -- one fit, in a task --------------------------------------------------------------

def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Split points per feature: midpoints of its values, or of ``bins`` quantiles."""
    out = []
    for c in x.T:
        v = np.unique(c)
        if len(v) > bins:
            v = np.unique(np.quantile(c, np.linspace(0, 1, bins)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _occupied(bins, g, node, count, size, width):
    """Histograms of ``count`` nodes of at most ``size`` rows each over the bins that
    occur: ``(rows, sum of g, bin)`` per (node, feature, place), the bins rising.
    ``bins`` has a row per entry of ``g`` and a column per feature of its node; the
    entries come node by node. Nodes of many rows get a place for every bin, and None
    for the bins."""
    features = bins.shape[1]
    if size >= width:
        size = width
        slot = (node[:, None] * features + np.arange(features)) * width + bins
        weights, bin_of = np.repeat(g, features), None
    else:
        first = np.searchsorted(node, np.arange(count))
        table = np.full((count, size, features), width)
        table[node, np.arange(len(node)) - first[node]] = bins
        weights = np.zeros((count, size))
        weights[node, np.arange(len(node)) - first[node]] = g
        order = table.argsort(axis=1, kind="stable")
        table = np.take_along_axis(table, order, axis=1)
        rank = np.zeros(table.shape, np.int64)
        np.cumsum(table[:, 1:] != table[:, :-1], axis=1, out=rank[:, 1:])
        slot = (np.arange(count)[:, None, None] * features + np.arange(features)) * size + rank
        weights = np.take_along_axis(weights[:, :, None], order, axis=1)
        bin_of = np.full(count * features * size, width)
        bin_of[slot.ravel()] = table.ravel()
        bin_of = bin_of.reshape(count, features, size)
        filled = table < width
        slot, weights = slot[filled], weights[filled]
    shape, cells = (count, features, size), count * features * size
    n = np.bincount(slot.ravel(), minlength=cells).reshape(shape)
    return n, np.bincount(slot.ravel(), weights, cells).reshape(shape), bin_of


def _splits(binned, g, rows, node, count, columns, width, score, p, first):
    """The best split of every node of a level: ``(gain, place in columns, bin, rows to
    the left, their sum, rows, sum)``. ``rows`` come node by node (``node``, rising);
    ``columns`` has the features a node may split on (one row: all the same); sums of
    whole nodes go over the bins of the feature ``first``. Nodes are taken by their
    size, at most ``CELLS`` histogram cells at once: the memory follows the rows and
    not the nodes."""
    features = columns.shape[-1]
    start = np.searchsorted(node, np.arange(count + 1))
    total = np.diff(start)
    gain, sum_left, sum_all = np.full(count, -np.inf), np.zeros(count), np.zeros(count)
    place, bin_, left = (np.zeros(count, np.int64) for _ in range(3))
    least = max(1, p["min_rows"])
    able = np.flatnonzero(total >= 2 * least)
    if count * features * width <= FEW_CELLS:
        size = np.full(len(able), width)
    else:
        size = np.minimum(2 ** np.ceil(np.log2(total[able])).astype(np.int64), width)
    for k in np.unique(size):
        group = able[size == k]
        cells = np.cumsum(np.maximum(total[group] * features, k * features))
        for part in np.split(group, np.flatnonzero(np.diff(cells // CELLS)) + 1):
            own, r = node, rows
            if len(part) < count:
                own = np.repeat(np.arange(len(part)), total[part])
                r = rows[np.arange(len(own)) + np.repeat(
                    start[part] - np.cumsum(total[part]) + total[part], total[part])]
            values = binned[r][:, columns] if columns.ndim == 1 else binned[
                r[:, None], columns[part][own]]
            n, s, bins = _occupied(values.astype(np.int64), g[r], own, len(part), int(k), width)
            if k == width and columns.ndim == 1:
                whole = s[:, :1].sum(axis=2, keepdims=True)
            else:
                whole = np.bincount(own * width + binned[r, first], g[r], len(part) * width)
                whole = whole.reshape(len(part), width).sum(axis=1)[:, None, None]
            n, s, every = n.cumsum(axis=2), s.cumsum(axis=2), total[part][:, None, None]
            found = (score(s, n) + score(whole - s, every - n) - score(whole, every)) / 2 - p["gamma"]
            found[(n < least) | (every - n < least)] = -np.inf
            best = found.reshape(len(part), -1).argmax(axis=1)
            f, b = np.divmod(best, found.shape[2])
            here = np.arange(len(part)), f, b
            gain[part], place[part], bin_[part] = found[here], f, b if bins is None else bins[here]
            left[part], sum_left[part], sum_all[part] = n[here], s[here], whole[:, 0, 0]
    return gain, place, bin_, left, sum_left, total, sum_all


def _tree(binned, edges, g, p, use, draw=None):
    """Grows one tree level by level on gradients ``g`` (one per row) and the
    features ``use``, of which ``draw(nodes)`` may allow an equal number to each node
    of a level; returns its nodes ``(left, right, feature, threshold, value)``."""
    lam, alpha = p["reg_lambda"], p["reg_alpha"]
    leaf_value = lambda gs, n: -_soft(gs, alpha) / np.maximum(n + lam, 1e-12)
    score = lambda gs, n: _soft(gs, alpha) ** 2 / np.maximum(n + lam, 1e-12)
    width = max(len(e) for e in edges) + 1
    cuts = np.zeros((len(edges), width))
    for f, e in enumerate(edges):
        cuts[f, :len(e)] = e
    rows, node = np.arange(len(g)), np.zeros(len(g), np.int64)  # rows of open nodes, by node
    values, inner = [leaf_value(g.sum(), len(g))[None]], []
    known, count = 1, 1                                         # nodes so far; open ones
    for _ in range(int(p["max_depth"]) if width > 1 and len(g) else 0):
        columns = use
        if draw is not None:
            columns = np.broadcast_to(use, (count, len(use)))[draw(count)].reshape(count, -1)
        gain, place, bin_, left, sum_left, total, sum_all = _splits(
            binned, g, rows, node, count, columns, width, score, p, use[0])
        good = np.flatnonzero(gain > 1e-12)
        if not len(good):
            break
        feature = use[place] if draw is None else columns[np.arange(count), place]
        kids = known + 2 * np.arange(len(good))
        inner.append((known - count + good, kids, feature[good], cuts[feature[good], bin_[good]]))
        values.append(np.stack([leaf_value(sum_left, left)[good],
                                leaf_value(sum_all - sum_left, total - left)[good]], 1).ravel())
        child = np.full(count, -1)
        child[good] = 2 * np.arange(len(good))
        live = child[node] >= 0
        rows, node = rows[live], node[live]
        node = child[node] + (binned[rows, feature[node]] > bin_[node])
        order = node.argsort(kind="stable")
        rows, node = rows[order], node[order]
        known, count = known + 2 * len(good), 2 * len(good)
    left, feature, threshold = np.full(known, -1), np.full(known, -1), np.zeros(known)
    for at, kids, f, t in inner:
        left[at], feature[at], threshold[at] = kids, f, t
    right = np.where(left < 0, -1, left + 1)
    return [list(n) for n in zip(*(c.tolist() for c in (
        left, right, feature, threshold, np.concatenate(values))))]


def _walk(nodes, x: np.ndarray, depths: Sequence[int] = (10 ** 6,)):
    """Values of one tree for the rows of ``x``, per depth of ``depths`` (rising)
    at which it is cut."""
    left, right, feature, threshold, value = (np.array(c) for c in zip(*nodes))
    at, depth, out = np.zeros(len(x), np.int64), 0, []
    for cut in depths:
        while depth < cut and (left[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(left[at] < 0, at, np.where(go, left[at], right[at]))
            depth += 1
        out.append(value[at])
    return out[0] if len(depths) == 1 else out


def _binned(x: np.ndarray):
    edges = _edges(x, BINS)
    small = np.min_scalar_type(max((len(e) for e in edges), default=0))
    return edges, np.stack([np.searchsorted(e, c, side="left").astype(small)
                            for e, c in zip(edges, x.T)], axis=1)


def features_per_split(draw: dict, features: int) -> int:
    """How many features a node may split on; draws that name the same number in
    different words (``sqrt``, ``log2``) are the same forest."""
    word = draw.get("max_features", "all")
    number = {"sqrt": math.sqrt(features), "log2": math.log2(features)}.get(word, features)
    return max(1, math.ceil(number))


def fit_forest(x: np.ndarray, y: np.ndarray, draw: dict, seed: int, watch):
    """Grows a forest; ``watch(k, tree)`` sees every tree as it is added. The
    forest's prediction is the mean of its trees."""
    d, rng = FOREST_DEFAULTS | draw, np.random.default_rng(seed)
    edges, binned = _binned(x)
    p = DEFAULTS | {"max_depth": d["max_depth"] or DEEPEST, "min_rows": d["min_samples_leaf"]}
    use, k = np.arange(x.shape[1]), features_per_split(d, x.shape[1])

    def some(nodes: int) -> np.ndarray:
        order = rng.random((nodes, len(use))).argsort(axis=1)
        return order.argsort(axis=1) < k

    for i in range(int(d["n_estimators"])):
        rows = np.sort(rng.integers(0, len(y), len(y)))
        watch(i + 1, _tree(binned[rows], edges, -y[rows], p, use, some))


def fit(x: np.ndarray, y: np.ndarray, draw: dict, seed: int, watch=None):
    """Boosts on ``(x, y)``. Returns ``(base, trees)``; ``watch(k, tree)`` sees
    every tree as it is added, its values scaled by the learning rate."""
    p, rng = parameters(draw), np.random.default_rng(seed)
    edges, binned = _binned(x)
    base = float(y.mean())
    now, trees = np.full(len(y), base), []
    n_rows = max(1, round(p["subsample"] * len(y)))
    n_cols = max(1, round(p["colsample_bytree"] * x.shape[1]))
    for k in range(int(p["n_estimators"])):
        rows = (np.arange(len(y)) if n_rows == len(y)
                else np.sort(rng.choice(len(y), n_rows, replace=False)))
        use = (np.arange(x.shape[1]) if n_cols == x.shape[1]
               else np.sort(rng.choice(x.shape[1], n_cols, replace=False)))
        nodes = _tree(binned[rows], edges, now[rows] - y[rows], p, use)
        for node in nodes:
            node[4] *= p["learning_rate"]
        now += _walk(nodes, x)
        trees.append(nodes)
        if watch:
            watch(k + 1, nodes)
    return base, trees


def node_table(base: float, trees: list) -> NodeTable:
    """A fitted ensemble as nodes; its prediction is the sum over trees. The base
    value is a tree of one leaf."""
    rows = [{"tree": 0, "node": 0, "left": None, "right": None, "feature": None,
             "threshold": None, "value": base}]
    rows += [{"tree": t + 1, "node": i, "left": n[0], "right": n[1], "feature": n[2],
              "threshold": n[3], "value": n[4]}
             for t, nodes in enumerate(trees) for i, n in enumerate(nodes)]
    return NodeTable.of(rows)


def r2(y: np.ndarray, predicted: np.ndarray) -> float:
    spread = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - predicted) ** 2).sum() / spread) if spread else float("nan")


# -- the search: one fit per row of a table ---------------------------------------------

def _boosted_scores(x, y, fold, f, draws, members, seed):
    """``(draw, R²)`` on fold ``f`` of boosting draws equal but for their trees."""
    train, valid = fold != f, fold == f
    wanted = {i: int(parameters(draws[i])["n_estimators"]) for i in members}
    now, out = np.full(int(valid.sum()), y[train].mean()), []

    def watch(k, nodes):
        now[:] += _walk(nodes, x[valid])
        out.extend((i, r2(y[valid], now)) for i, n in wanted.items() if n == k)

    fit(x[train], y[train], draws[max(wanted, key=wanted.get)], seed, watch)
    return out


def _forest_scores(x, y, fold, f, draws, members, seed):
    """``(draw, R²)`` on fold ``f`` of forest draws equal but for trees and depth."""
    train, valid = fold != f, fold == f
    own = {i: FOREST_DEFAULTS | draws[i] for i in members}
    depth = {i: int(d["max_depth"] or DEEPEST) for i, d in own.items()}
    cuts = sorted(set(depth.values()))
    sums, out = np.zeros((len(cuts), int(valid.sum()))), []

    def watch(k, nodes):
        values = _walk(nodes, x[valid], cuts)
        sums[:] += values if len(cuts) > 1 else [values]
        out.extend((i, r2(y[valid], sums[cuts.index(depth[i])] / k))
                   for i, d in own.items() if int(d["n_estimators"]) == k)

    most = {"n_estimators": max(int(d["n_estimators"]) for d in own.values()),
            "max_depth": max(depth.values())}
    fit_forest(x[train], y[train], next(iter(own.values())) | most, seed, watch)
    return out


def search(spark: SparkSession, sample, draws: list[dict], folds: int, seed: int,
           forest: bool = False) -> list[float]:
    """Mean R² over the folds of every draw of a boosting or a forest search. Draws
    that share a fit are one row of a table per fold, and every row is a task."""
    ship(spark)
    groups: dict[tuple, list[int]] = {}
    for i, d in enumerate(draws):
        if forest:
            d = FOREST_DEFAULTS | d
            rest = (d["min_samples_leaf"], features_per_split(d, sample[0].shape[1]))
        else:
            rest = tuple(sorted((k, v) for k, v in parameters(d).items() if k != "n_estimators"))
        groups.setdefault(rest, []).append(i)
    jobs = [(members, f) for members in groups.values() for f in range(folds)]
    shared = spark.sparkContext.broadcast((sample, draws))
    score = _forest_scores if forest else _boosted_scores

    def run(frames):
        import pandas as pd
        (x, y, fold), all_draws = shared.value
        for frame in frames:
            out = [(i, r) for members, f in zip(frame["draws"], frame["fold"])
                   for i, r in score(x, y, fold, int(f), all_draws, [int(m) for m in members],
                                     seed)]
            yield pd.DataFrame(out, columns=["draw", "r2"])

    table = spark.createDataFrame(jobs, "draws array<int>, fold int").repartition(len(jobs))
    try:
        scores = (table.mapInPandas(run, "draw int, r2 double")
                  .groupBy("draw").agg(F.avg("r2").alias("r2")).collect())
    finally:
        shared.unpersist()
    found = {r.draw: r.r2 for r in scores}
    return [found[i] for i in range(len(draws))]


def fit_one(spark: SparkSession, sample, draw: dict, seed: int) -> NodeTable:
    """One model on the whole sample, grown in a task."""
    ship(spark)
    shared = spark.sparkContext.broadcast(sample)

    def run(frames):
        import pandas as pd
        x, y, _ = shared.value
        for _ in frames:
            base, trees = fit(x, y, draw, seed)
            yield pd.DataFrame(node_table(base, trees).rows(), columns=[
                "tree", "node", "left", "right", "feature", "threshold", "value"])

    try:
        one = spark.range(0, 1, 1, 1).mapInPandas(
            run, "tree int, node int, `left` double, `right` double, feature double, "
                 "threshold double, value double")
        rows = [{k: int(v) if k in ("left", "right", "feature") and v is not None and v == v
                 else None if k in ("left", "right", "feature") else v
                 for k, v in r.asDict().items()} for r in one.collect()]
    finally:
        shared.unpersist()
    return NodeTable.of(rows)
