"""Connected components and group-safe splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracewright.session import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every id on an edge: (id, component).

    Alternates large-star and small-star steps, each one aggregation by node with map-side combine,
    until the edges are stars; every round is a table in the shared folder. A node's
    neighbours are never gathered in one place, so a hub of any degree is only a large join key,
    which adaptive execution splits. Null ids and self loops link nothing. Rounds grow with the logarithm of the
    longest chain; an error is raised if ``rounds`` of them do not suffice.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    current = scratch.save(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        # large star: every larger neighbour of a node links to the least of the node and its neighbours
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        # small star: a node and its smaller neighbours link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", "m")).distinct()
        nxt = scratch.save(small, "small")
        scratch.drop(large, current)
        current = nxt
        # done when every node has one edge and none is both above and below another
        sides = current.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(current.select("v", F.lit(0), F.lit(1)))
        if sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())
