"""Connected components of a link table, by alternating star contractions (Kiveris et al., 2014) as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import staged

#: Nodes that can have over a HUBS-th of all edges: at most so many.
HUBS = 1000


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child; contractions keep components, so that each star is one then."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("child")), F.struct(F.col("v").alias("n"), F.lit(0).alias("child")))).alias("x")).select("x.n", "x.child")
    roles = ends.groupBy("n").agg(F.sum("child").alias("children"), F.min("child").alias("least"))
    return roles.where("children > 1 or (children = 1 and least = 0)").isEmpty()


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the m of their u, from ``least`` (u, m, n edges of u in this table).

    At most HUBS nodes have over a HUBS-th of all edges each: their minima are broadcast, so that a hub's edges are never dealt to one task.
    """
    least = staged(least, "least")
    total = least.agg(F.sum("n")).first()[0] or 0
    hub = F.col("n") * HUBS > total
    hubs = least.where(hub).select("u", "m")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(~hub).select("u", "m").hint("merge"), "u")
    return edges.join(F.broadcast(hubs), "u").select("u", "v", "m").unionAll(rest.select("u", "v", "m"))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node with a link; label is the smallest node of its component.

    A round links every larger neighbour to the smallest one (large star), then does so for smaller neighbours (small star).
    Neighbourhoods are never gathered: minima are pre-aggregated, and joined back to the edges.
    """
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    counted = (F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    while not _is_star_forest(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(*counted).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large-star")
        small = _with_least(large, large.groupBy("u").agg(*counted)).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        edges = staged(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
