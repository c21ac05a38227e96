"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node that has a link.

    ``links`` has long columns a, b; direction, order, repeats and self-links do not matter.
    Each round is two aggregates (partial minima) and two joins that adaptive execution can
    split on hot nodes; it is written to the shared checkpoint folder.  The number of rounds
    grows with the logarithm of the longest path.
    """
    edges, n = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while n:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, n = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
