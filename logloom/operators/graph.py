"""Connected components of an edge list, without collecting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.lineage import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Label each vertex with the smallest vertex of its component.

    Returns ``(vertex, component)`` with one row per vertex that occurs in
    ``edges``. Every round hooks each vertex to the smallest label around it and
    then follows that label once (pointer jumping), so a path of length d needs
    about log2(d) rounds and a star two. Aggregates are partial on the map side,
    so a hub with many edges sends one row per task; the joins are plain equi
    joins that adaptive execution can split. Each round ends in a checkpoint.
    Labels only fall, so the rounds end; their number is not bounded by a parameter.
    Null endpoints are ignored; self loops and repeated edges are harmless.

    >>> # (1,2),(2,3),(4,4) gives 1:1, 2:1, 3:1, 4:4
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("vertex"), "label")
    labels = cut_lineage(labels)
    while True:
        # hook: the smallest label among the neighbours, given to the vertex and to its present root
        seen = both.join(labels, both["b"] == labels["vertex"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(seen, labels["vertex"] == seen["a"], "left").select(
            "vertex", "label", F.least("label", F.coalesce("near", "label")).alias("low")
        )
        hooked = cut_lineage(hooked)
        roots = hooked.groupBy(F.col("label").alias("root")).agg(F.min("low").alias("root_low"))
        # jump: a label is itself a vertex whose root may have become smaller
        moved = hooked.join(roots, hooked["low"] == roots["root"], "left").select(
            "vertex", "label", F.least("low", F.coalesce("root_low", "low")).alias("next")
        )
        moved = cut_lineage(moved)
        changed = moved.where("next <> label").limit(1).count()
        labels = moved.select("vertex", F.col("next").alias("label"))
        if not changed:
            return labels.select("vertex", F.col("label").alias("component"))
