"""Connected components of an edge table by alternating large-star and small-star rounds.

All state stays in DataFrames; each round is cut by a reliable checkpoint. Rounds grow
with the logarithm of the longest chain. A node with many links is reduced by ``min``, and
its least neighbour reaches its links without a shuffle: nodes with a thousandth of all
links, of which there are 2,000 at most, are broadcast. So no group meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.scratch import cut


HUB = 1000  # a node with this part of all links is a hub


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``a, b, m``: each edge with the ``m`` of its ``a`` in ``least`` (``a, m, degree``)."""
    hubs = F.broadcast(least.where(F.col("degree") * HUB >= links).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    others = least.where(F.col("degree") * HUB < links).select("a", "m")
    marked = edges.join(hubs, F.col("a") == F.col("hub"), "left")
    return marked.where("hub is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(
        marked.where("hub is null").select("a", "b").join(others, "a").select("a", "b", "m")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``); the least node names it.

    Self-links and repeated links change nothing; links with a null end are dropped.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("degree"))
        large = _with_least(both, least, state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = _with_least(large, least, state[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def least_names(components: DataFrame, names: DataFrame) -> DataFrame:
    """``node, component_id``: the least name in each node's component; ``names``: ``node, head``."""
    joined = components.join(names, "node")
    return joined.join(joined.groupBy("component").agg(F.min("head").alias("component_id")), "component").select("node", "component_id")
