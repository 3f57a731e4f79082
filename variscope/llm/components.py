"""Connected components by contraction: edges and labels stay in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variscope.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """``vertex``, ``component`` for every vertex of the undirected edges (a, b); the component is its least vertex.

    Each round points every vertex at its least neighbour, follows the pointers to their roots by doubling,
    and contracts the edges to roots; the vertices at least halve. Loops and null ends are left out.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        ends = edges.union(edges.select("b", "a"))
        near = ends.groupBy("a").agg(F.min("b").alias("b"))
        pointers = stored(near.select(F.col("a").alias("vertex"), F.least("a", "b").alias("root")), "pointers")
        moved = not pointers.isEmpty()
        while moved:
            above = pointers.select(F.col("vertex").alias("_v"), F.col("root").alias("_r"))
            step = pointers.join(above, F.col("root") == F.col("_v"), "left")
            pointers = stored(step.select("vertex", F.coalesce("_r", "root").alias("root"), F.coalesce(F.col("_r") != F.col("root"), F.lit(False)).alias("moved")), "pointers")
            moved = not pointers.filter("moved").isEmpty()
            pointers = pointers.select("vertex", "root")
        roots = pointers.select(F.col("vertex").alias("_v"), F.col("root").alias("_r"))
        if labels is None:
            labels = pointers.select("vertex", F.col("root").alias("component"))
        else:
            further = labels.join(roots, F.col("component") == F.col("_v"), "left")
            labels = stored(further.select("vertex", F.coalesce("_r", "component").alias("component")), "labels")
        ends = roots.select(F.col("_v").alias("_w"), F.col("_r").alias("_s"))
        contracted = edges.join(roots, F.col("a") == F.col("_v")).join(ends, F.col("b") == F.col("_w")).filter("_r <> _s")
        edges = stored(contracted.select(F.least("_r", "_s").alias("a"), F.greatest("_r", "_s").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels
