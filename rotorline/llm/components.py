"""Connected components of a graph given as links, by alternating large and small stars.

Each round hangs the neighbours of every vertex on the smallest vertex it sees, with a minimum per
vertex and a join, so that no task holds the neighbours of one vertex. Rounds are checkpointed; they
end when the links no longer change, after about as many rounds as the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotorline.llm.common import settled


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (hi, lo), hi > lo, rehung: the larger (or the smaller) neighbours of every vertex to its minimum."""
    if large:
        seen = links.select(F.col("hi").alias("v"), F.col("lo").alias("w")).union(
            links.select(F.col("lo").alias("v"), F.col("hi").alias("w")))
        least = seen.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        hung = links.select(F.col("lo").alias("v"), "hi").join(least, "v").select("hi", F.col("m").alias("lo"))
    else:
        least = links.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("m"))
        below = links.select(F.col("hi").alias("v"), "lo").join(least, "v").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        hung = below.union(least.select(F.col("v").alias("hi"), F.col("m").alias("lo")))
    return hung.filter("hi <> lo").distinct()


def _mark(links: DataFrame) -> tuple:
    """What tells whether two sets of links are the same: their number and a sum over them."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of `links` (hi, lo; hi > lo) but the roots: root is the smallest reachable."""
    links = settled(links.filter("hi <> lo").distinct())
    mark = _mark(links)
    while mark[0]:
        links = settled(_star(_star(links, large=True), large=False))
        before, mark = mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("hi").alias("vertex"), F.col("lo").alias("root"))
