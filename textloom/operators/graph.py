"""Connected components of links, in star rounds on tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.scratch import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` between different nodes: root is the smallest node of its component.

    Alternating large-star and small-star until a round changes nothing: each round at least halves long paths, and a hub is only
    ever met in a join, whose skewed partitions Spark splits.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")

    def mark(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(2**31)))).first()

    seen = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = stored(small, "cc")
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
