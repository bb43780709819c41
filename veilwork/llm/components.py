"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least one. The minima are written, so that a join with a hub's links can be split."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the least of them. A node has few smaller ones after a large star."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` with comparable ids -> ``(id, component)`` for every linked id; component is the smallest id reachable.

    Rounds go on until one changes nothing; their number grows with the logarithm of the longest path. Each round is
    written to the shared folder, so no lineage grows and no list of ids meets on the driver. Minima are grouped before
    they are joined, so a hub costs one row per link, never a pair per two of its links. Links with a null end, links of
    an id to itself and repeated links count for nothing; an empty input gives an empty result.
    """
    edges = links.filter("a is not null and b is not null and a != b")
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (state := edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before and state[0]:
        before = state
        edges = written(_small_star(_large_star(edges).filter("u != v").distinct()), "links")
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("id"), "component").union(roots.select("component", "component").distinct())
