"""Connected components of a link table, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewalk.sources.store import cut


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def component_roots(links: DataFrame) -> DataFrame:
    """(node, component) for every node in `links` (a, b): the least node reachable.

    Each round every node points to the neighbour, or itself, that comes first
    in an order by hash, and links are carried over to what their ends point to.
    The order is random to the ids, so a constant part of the nodes goes each
    round, long chains included.  Pointers are aggregated before the shuffle, so
    a node with very many links is no burden; each round is a written table, and
    the driver only learns whether links are left.
    """
    links = cut(links.select("a", "b").where("a <> b").distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    pointers = []
    while not links.isEmpty():
        salt = F.lit(len(pointers))
        ends = _both_ways(links)
        nearest = ends.groupBy("a").agg(
            F.min(F.struct(F.xxhash64("b", salt).alias("h"), "b")).alias("n")
        )
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("b"))
        points = cut(nearest.select(F.col("a").alias("node"), F.least(own, F.col("n"))["b"].alias("to")))
        pointers.append(points)
        moved = (
            links.join(points.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(points.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y")
        )
        links = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    def follow(later: DataFrame, earlier: DataFrame) -> DataFrame:
        on = later.select(F.col("node").alias("to"), F.col("to").alias("root"))
        return earlier.join(on, "to", "left").select("node", F.coalesce("root", "to").alias("to"))

    roots = cut(reduce(follow, reversed(pointers)))
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    return roots.join(least, "to").select("node", "component")
