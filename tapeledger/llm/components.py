"""Connected components of a distributed edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeledger.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


#: Up to so many edges are kept in one partition, where no step needs an exchange.
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest node.

    Each round takes, per node, the least neighbour (combined before the shuffle, so a hub costs one row per
    task) and points the other neighbours at it. Rounds grow with the logarithm of the longest chain. Every
    round is written to the shared folder. Rows with a null end and loops are ignored (a node that has only a
    loop is not returned); repeated edges count once; no edges give an empty table.
    """
    edges = edges.select("u", "v").filter("u <> v").distinct()
    edges = cut_lineage(edges, name)
    few = edges.count() <= FEW_EDGES  # the number of edges never grows
    mark = None
    while True:
        if few:
            edges = edges.coalesce(1)
        after = cut_lineage(_small_star(_large_star(edges)), name)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        edges = after
        if state == mark:
            break
        mark = state
    edges = edges.coalesce(1) if few else edges
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
