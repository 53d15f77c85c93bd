"""Connected components over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.plans.durable import durable


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): component is the smallest id that it reaches.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every vertex hands its larger, then
    its smaller neighbours to the least of its neighbourhood, until all edges are stars. A step is one
    aggregation by vertex, combined before the shuffle, and one join; a vertex with many neighbours
    is many rows of that join, never one list. Each round's edges are written to the shared folder.
    """
    spark = edges.sparkSession
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if not now.head(1):
            break
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = durable(small, "edges")
        same = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        done = same(after) == same(now)
        now = after
        if done:
            break
    else:
        raise RuntimeError(f"components are not stars after {rounds} rounds")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(now.select("b", "b").distinct()) if now.head(1) else spark.createDataFrame([], "id long, component long")
