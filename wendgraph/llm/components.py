"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the least node that it is linked to, over any number of links) of each node of the links a, b.

    Each round is an aggregation and a join, in which hot nodes are salted, written to the shared folder, so that lineage stays short; nothing but
    the count of links and a checksum comes to the driver. Null ends and loops are left out.
    """
    edges = shared.written(_tidy(links.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    state = _state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = shared.joined(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a > b from here on
        smaller = shared.written(_tidy(large), "links")
        least = smaller.groupBy("a").agg(F.min("b").alias("m"))
        small = shared.joined(smaller, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = shared.written(_tidy(small), "links")
        new = _state(edges)
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = new
    raise RuntimeError(f"no end of the components after {most_rounds} rounds")


def _tidy(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
