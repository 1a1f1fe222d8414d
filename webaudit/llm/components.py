"""Connected components of a link table, in rounds that write tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, stored


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` of every linked node; ``comp`` is the smallest node it is linked with.

    Alternating large-star and small-star rounds: each node points its neighbours at the
    smallest one, so paths shorten to stars in a logarithm of their length. Links are rows
    throughout and minima combine before each shuffle, so no component meets in one task.
    The rounds keep all nodes and end when links and centres add up to the nodes: a component of
    ``k`` nodes has ``k - 1`` links and one centre only as a star around its smallest.
    ``links``: ``a, b`` in any direction; self-links are dropped. No links: no rows.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
            "a <> b")

    edges, drop = stored(ordered(links).distinct(), "links")
    nodes = edges.select(F.explode(F.array("a", "b"))).distinct().count()
    while sum(edges.agg(F.count("*"), F.countDistinct("b")).first()) > nodes:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours go to the smallest of the neighbourhood, a row for each link.
        large = ordered(both.join(low, "a").where("b > a").select(F.col("b").alias("a"),
                                                                  F.col("m").alias("b")))
        # Small star: smaller neighbours, and the node, go to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = ordered(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                        .unionByName(least.select("a", F.col("m").alias("b")))).distinct()
        last, (edges, drop) = drop, stored(small, "links")
        last()
    found = cut_lineage(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()), "groups")
    drop()
    return found
