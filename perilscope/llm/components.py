"""Connected components of an edge table, by minimum labels with jumps.

Each round every node takes the smallest label among its neighbours and then
the label of its label, so a chain of length d needs about log(d) rounds.
Tables of a round are written to the shared folder (no lineage grows, a lost
executor loses nothing); only the number of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(a, b)`` bigint edges -> ``(node, component)``, component = least node."""
    both = stage(edges.select("a", "b").where("a <> b")
                 .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
                              .where("a <> b")).distinct(), f"{name}-edges")
    label = stage(both.groupBy(F.col("a").alias("node"))
                  .agg(F.min("b").alias("low"))
                  .select("node", F.least("node", "low").alias("component")),
                  f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = (both.join(label, both["b"] == label["node"])
                 .groupBy(both["a"].alias("to")).agg(F.min("component").alias("low")))
        told = (label.join(heard, label["node"] == heard["to"])
                .select("node", F.least("component", "low").alias("component"),
                        F.col("component").alias("was")))
        up = label.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        jumped = (told.join(up, told["component"] == up["__n"])
                  .select("node", F.least("component", "__c").alias("component"), "was"))
        new = stage(jumped, f"{name}-{step}")
        changed = new.where("component <> was").count()
        label = new.select("node", "component")
        if changed == 0:
            return label
