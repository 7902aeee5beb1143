"""Connected components of large graphs by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for the nodes of edges (columns a, b).

    Each round hangs larger neighbours on the smallest one; the rounds follow the logarithm of the
    longest path. Every round is a table in the shared folder. Loops and repeated edges don't matter;
    nodes without an edge to another node are not returned.
    """
    now, seen = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if state == seen or not state[0]:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def united(linked: DataFrame, found: DataFrame) -> DataFrame:
    """linked (node, component, as components gives) after further edges found (a, b).

    The new edges are drawn between the components there are, so the rounds follow the new links only.
    """
    edges = found
    for side in "ab":
        of = linked.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}"))
        edges = edges.join(of, side, "left").withColumn(side, F.coalesce(f"c_{side}", side)).drop(f"c_{side}")
    fresh = written(components(edges.distinct()), "united")
    moved = linked.join(fresh.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    return written(moved.union(fresh.join(linked, "node", "left_anti")), "components")
