"""Distributed connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node that has an edge to another, the smallest node that it can reach.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours likewise; the number of
    rounds grows with the logarithm of the longest path. Rounds are staged in the shared folder. Nulls and loops are
    ignored; repeated edges count once; an empty table gives an empty result.
    """
    pair = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = C.stage(pair.where("u is not null and v is not null and u <> v").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        seen = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = _named(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = C.stage(_hung(both, nodes, "v > u").distinct(), "edges")
        C.discard(now, nodes)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        nodes = _named(least)
        now = C.stage(_hung(large, nodes, "v <> m").union(least.select("u", "m")).distinct(), "edges")
        C.discard(large, nodes)


def _named(least: DataFrame) -> DataFrame:
    """Nodes staged with the least of their neighbours: both sides of the joins with them are then plain exchanges, whose
    partitions Spark splits where a node has many neighbours."""
    return C.stage(least.select(F.col("u").alias("__u"), "m"), "nodes")


def _hung(edges: DataFrame, nodes: DataFrame, kept: str) -> DataFrame:
    """The neighbours v of each node u, hung on its m."""
    return edges.join(nodes, edges.u == nodes["__u"]).where(kept).select(F.col("v").alias("u"), F.col("m").alias("v"))
