"""Tree ensembles as node tables.

A fitted ensemble is a table of nodes: ``tree, node, left, right, feature,
threshold, value`` (a leaf has no children; an inner node's ``value`` is what
it would predict if it were a leaf). Rows are scored by walking all trees at
once, Arrow batch by batch; the table, whose size is that of the model and never
of the data, is a broadcast.

Because inner nodes carry values, one deep fit of many trees holds every
shallower and smaller ensemble of the same family: cutting all trees at a depth,
and the ensemble after its first trees, gives a valid ensemble of that size. It
is not bit for bit the one that a separate fit would draw, since the learners
draw features node by node.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_path

NODE_SCHEMA = ("tree int, node int, `left` int, `right` int, feature int, "
               "threshold double, value double")
DEEPEST = 30
CELLS = 1 << 20         # rows x trees walked at once


@dataclass
class NodeTable:
    """Nodes of all trees in one numbering; a leaf is its own child."""
    roots: list[int]
    left: list[int]
    right: list[int]
    feature: list[int]
    threshold: list[float]
    value: list[float]

    @classmethod
    def of(cls, rows) -> "NodeTable":
        """From rows of :data:`NODE_SCHEMA`, in any order."""
        rows = sorted(rows, key=lambda r: (r["tree"], r["node"]))
        at = {(r["tree"], r["node"]): i for i, r in enumerate(rows)}
        child = lambda r, i, side: (
            at[r["tree"], r[side]] if r["left"] is not None and r["left"] >= 0 else i)
        out = cls([], [], [], [], [], [])
        for i, r in enumerate(rows):
            if r["node"] == 0:
                out.roots.append(i)
            out.left.append(child(r, i, "left"))
            out.right.append(child(r, i, "right"))
            out.feature.append(max(0, r["feature"] if r["feature"] is not None else 0))
            out.threshold.append(r["threshold"] if r["threshold"] is not None else 0.0)
            out.value.append(r["value"])
        return out

    def rows(self) -> list[tuple]:
        """Rows of :data:`NODE_SCHEMA`."""
        out, tree, first = [], -1, 0
        starts = set(self.roots)
        for i in range(len(self.value)):
            if i in starts:
                tree, first = tree + 1, i
            leaf = self.left[i] == i
            out.append((tree, i - first, None if leaf else self.left[i] - first,
                        None if leaf else self.right[i] - first,
                        None if leaf else self.feature[i],
                        None if leaf else self.threshold[i], self.value[i]))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_SCHEMA)

    def sums(self, spark: SparkSession, x: Column,
             cuts: Sequence[tuple[int, int | None]] = ((DEEPEST, None),)) -> Column:
        """Per ``(depth, trees)`` of ``cuts`` the sum of the first ``trees`` trees'
        values (all: None), every tree cut at ``depth``, for rows with feature array
        ``x``: an array column in the order of ``cuts``."""
        shared = spark.sparkContext.broadcast((
            np.array(self.roots), np.array(self.left), np.array(self.right),
            np.array(self.feature), np.array(self.threshold), np.array(self.value)))
        cuts, cells = list(cuts), CELLS

        def walk(rows: np.ndarray) -> np.ndarray:
            roots, left, right, feature, threshold, value = shared.value
            at = np.repeat(roots[None, :], len(rows), axis=0)
            out, depth = np.empty((len(rows), len(cuts))), 0
            for k in sorted(range(len(cuts)), key=lambda k: cuts[k][0]):
                while depth < cuts[k][0]:
                    go = np.take_along_axis(rows, feature[at], axis=1) <= threshold[at]
                    after = np.where(go, left[at], right[at])
                    depth = cuts[k][0] if (after == at).all() else depth + 1
                    at = after
                out[:, k] = value[at[:, :cuts[k][1]]].sum(axis=1)
            return out

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            step = max(1, cells // max(1, len(shared.value[0])))
            found = [walk(rows[i:i + step]) for i in range(0, len(rows), step)]
            return pd.Series([r for part in found for r in part], dtype=object)

        return score(x)


def features_array(features: str = "features") -> Column:
    return vector_to_array(F.col(features))


def of_model(spark: SparkSession, model) -> NodeTable:
    """The node table of a fitted Spark ensemble, read from the table that Spark
    itself saves it as (under the shared checkpoint folder)."""
    path = stage_path(spark, "ensemble")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    node = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data
    rows = node.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("prediction").alias("value")).collect()
    return NodeTable.of(rows)
