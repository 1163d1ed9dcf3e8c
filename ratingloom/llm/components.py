"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and component (the smallest node reachable) of every node of `edges` (a, b).

    Alternates two steps until nothing changes: every node hooks its larger
    neighbours to its smallest one, then its smaller neighbours. Each step is a
    minimum per node and a join with it, so a node with very many neighbours is
    combined before the shuffle and its join is split by Spark. Self edges, both
    directions and repeats are allowed; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, state, turn = scratch.write(e, f"{name}-0"), None, 0
    while True:
        row = current.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if row["n"] == 0 or (row["n"], row["s"]) == state:
            break
        state, turn = (row["n"], row["s"]), turn + 1
        both = current.select("a", "b").union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = scratch.write(hooked.union(smallest.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        current = following
    # every edge now leads to the smallest node
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b").distinct())
