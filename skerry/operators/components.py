"""Connected components of an undirected graph, by rounds of least-label exchange and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources.durable import durable


def connected_components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """vertices (v long), edges (a long, b long) -> (v, component): the least vertex of each component.

    A round takes the least label among a vertex and its neighbours (pre-aggregated before the
    shuffle, so a hub costs no more than its edges) and then follows the label once, which halves the
    remaining distance; every round is written to the shared folder. Vertices without edges are
    components of their own; edges to unknown vertices, null ends and repeated edges do no harm."""
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = durable(ends.union(ends.select("b", "a")).distinct(), "edges")
    labels = durable(vertices.where("v IS NOT NULL").select("v").distinct().withColumn("component", F.col("v")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "v", "left").select("v", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("component").alias("far"))
        moved = durable(hooked.join(jump, "low", "left").select("v", "component", F.least("low", "far").alias("next")), "labels")
        changed = not moved.where("next <> component").isEmpty()
        labels = moved.select("v", F.col("next").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
