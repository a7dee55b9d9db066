"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (a, b; long, not null) touches; root: the component's smallest node.

    Every step writes the edges to the shared folder, so lineage stays short and a lost executor costs one step. A hot node's
    minimum is combined before the shuffle; its edges meet it again in a join that Spark can split. Takes about
    log(diameter) rounds: long chains are halved by each. Ends when all edges are stars: no root has a smaller neighbour, no node two roots.
    """
    e = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"))  # read four times, and costly to find
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))  # large star: larger neighbours go to the smallest one
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        e = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("low").alias("a"), "b").where("a < b")
        least = e.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("n"), "low")  # small star: so do the smaller ones
        met = e.join(least, F.col("b") == F.col("n"))
        small = met.select(F.explode(F.array(F.struct(F.col("low").alias("x"), F.col("b").alias("y")), F.struct(F.col("low").alias("x"), F.col("a").alias("y")))).alias("s"))
        e = stored(small.select(F.col("s.x").alias("a"), F.col("s.y").alias("b")).where("a < b").distinct())
        roles = e.select("b", F.lit(0).alias("root")).unionByName(e.select(F.col("a").alias("b"), F.lit(1).alias("root")).distinct())
        if roles.groupBy("b").agg(F.max("root").alias("root"), F.sum(1 - F.col("root")).alias("n")).where("n > 1 or (n = 1 and root = 1)").isEmpty():
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
