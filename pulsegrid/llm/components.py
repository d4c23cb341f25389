"""Connected components of a link table by alternating large-star and small-star steps; nothing meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise


def written(df: DataFrame, name: str) -> DataFrame:
    """A table of hashes and counts, written as it is: hashes do not compress, and a compressor's memory stays with its thread."""
    return materialise(df, name, "uncompressed")


def _star(edges: DataFrame, near: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the least node near each centre: the larger ones (large), or the smaller ones and the centre."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    hung = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that can be reached.

    Each step writes its edges to the shared folder. It ends when a pair of steps changes no edge.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = written(_star(edges, both, large=True), "edges")
        edges = written(_star(edges, edges, large=False), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
