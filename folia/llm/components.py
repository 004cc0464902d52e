"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import forget, written


def link_mark() -> list:
    """Aggregates that tell tables of distinct links apart, whatever their number and order."""
    return [F.count("*"), F.bit_xor(F.xxhash64("a", "b"))]


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): root is the component's smallest node.

    Each round hooks every node to the smallest of its neighbours, with an aggregate and an
    equi-join (whose large partitions the adaptive plan splits), so a node with very many
    neighbours is never gathered in one place.  Rounds end when no link changes, after a number
    of them in the order of the logarithm of the nodes; each is written to the shared folder.
    Self-links and repeated links are fine; without links the result is empty.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = written(now, "links"), None
    while True:
        mark = tuple(now.agg(*link_mark()).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen = mark
        both = now.union(now.select("b", "a"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large_stars")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        for done in (before, least, large, low):  # each is read for the last time above
            forget(done)
