"""Connected components of a large edge table, by rounds of star operations, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: long), root the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round points nodes at smaller neighbours. A
    node's neighbours are never gathered; a round is two aggregations (minimum by node) and two joins, of which Spark splits
    skewed partitions, and its number grows with the logarithm of the longest path. Loops and repeated edges don't matter.
    No side is broadcast, however small it seems: rounds follow each other fast, and the driver would hold the tables of many."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    for _ in range(most_rounds):
        # Large star: each larger neighbour of u points at the smallest of u and its neighbours.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), both["u"] == least["k"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: u and its smaller neighbours point at the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(low.hint("merge"), large["u"] == low["k"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()
        new = written(small, "edges")
        n = new.agg(F.count("*"), F.countDistinct("u")).first()
        if n[0] == n[1] and new.alias("x").join(new.alias("y").hint("merge"), F.col("x.v") == F.col("y.u"), "left_semi").isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
