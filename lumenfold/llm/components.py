"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregation and a join whose result is staged in the shared
folder, so no component ever meets in one task or on the driver, and a lost
executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every linked node but the roots themselves; root is the smallest node of its component."""
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    edges, path = stage(edges, "links")
    spark, before = edges.sparkSession, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2**31)).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        wide, wide_path = stage(_large_star(edges), "links")
        after, after_path = stage(_small_star(wide), "links")
        drop(spark, path, wide_path)
        before, edges, path = now, after, after_path
