"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored


def _star(edges: DataFrame) -> DataFrame:
    """Large-star then small-star: both keep the components and draw links towards the smallest node.

    Each step groups by node with a plain minimum, so a node of very many links is combined before the shuffle.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    # From here on a > b: every node knows smaller ones only.
    large = large.filter("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b")))
    return small.distinct()


def connected(links: DataFrame) -> DataFrame:
    """(cid, label) of every node of links(a, b): label is the smallest node it is connected with.

    Each round is written once; rounds grow with the logarithm of the longest path. No links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = stored(edges, "star")
    known = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == known:
            break
        known = mark
        edges = stored(_star(edges), "star")
    roots = edges.select(F.col("b").alias("cid"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("cid"), F.col("b").alias("label")).union(roots)
