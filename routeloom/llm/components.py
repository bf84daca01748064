"""Connected components by joins and sums only: no group is ever gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Each round lets every node point at its smallest neighbour. The pointers form trees whose only
    cycle is a pair holding the tree's smallest node, which becomes the root; they are followed to
    the roots and the graph is contracted to these. Every tree has two nodes at least, so a
    component of n nodes is done in log2(n) rounds. Every round's tables are written to the shared
    folder, which cuts lineage.

    Returns (node, root). Nulls and loops are no edges; no edges give no rows; repeated edges and
    either direction count once.
    """
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = settle(live.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = settle(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")), "pointers")
        over = nearest.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        paired = F.when(F.col("top") == F.col("node"), F.least("node", "root")).otherwise(F.col("root"))
        written = settle(nearest.join(over, nearest["root"] == over["mid"]).select("node", paired.alias("root")), "pointers")
        discard(nearest)
        while True:
            step = written.select("node", "root")
            over = step.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            jumped = settle(step.join(over, step["root"] == over["mid"]).select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "pointers")
            discard(written)
            written = jumped
            if jumped.where("moved").isEmpty():
                break
        step = written.select("node", "root")
        if labels is None:
            labels = written
        else:
            over = step.select(F.col("node").alias("mid"), F.col("root").alias("top"))
            moved = labels.join(over, labels["root"] == over["mid"], "left").select("node", F.coalesce("top", "root").alias("root"))
            last, labels = labels, settle(moved, "labels")
            discard(last)
        to_u = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        to_v = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        joined = live.join(to_u, "u").join(to_v, "v").where("ru <> rv")
        last, live = live, settle(joined.select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v")).distinct(), "edges")
        discard(last, *([] if labels is written else [written]))
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels.select("node", "root")
