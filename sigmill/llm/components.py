"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.common import materialize


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in ``links`` (columns ``a``, ``b``, longs).

    Large-star and small-star steps by turns until all links point at their component's smallest node; every step
    groups by node with partial aggregation and is written before the next, and two numbers reach the driver.
    Nodes without a link don't appear; loops (a = b) and repeated links are harmless.
    """
    links = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        # large star: neighbours larger than a node move to the smallest of its neighbourhood
        both = _both_ways(links)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        links = materialize(small.select("x.a", "x.b").filter("a <> b").distinct())
        # settled when every node has one link and none of the targets has a link of its own
        tops = links.select("b").distinct().withColumn("top", F.lit(1))
        found = links.groupBy("a").agg(F.count("*").alias("n")).join(tops, F.col("a") == F.col("b"), "left")
        most, nested = found.agg(F.max("n"), F.count("top")).first()
        if (most or 0) <= 1 and not nested:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    children = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return children.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
