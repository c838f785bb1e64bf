"""Connected components of a link table by alternating large and small stars.

Each round is two grouped minimums (partially aggregated, so a hub with very many links sends one row a task) and
two joins that Spark may split on skewed keys. Rounds end when the links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import saved


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one centre and no centre has another."""
    centres = edges.select(F.col("v").alias("u"))
    return edges.join(centres, "u", "left_semi").isEmpty() and edges.distinct().groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node) for every node of ``links(a, b)`` (longs; a written table)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = saved(small.distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
