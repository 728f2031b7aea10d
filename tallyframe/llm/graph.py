"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link; ``root`` is the smallest node of its component.

    ``links`` has two columns of one ordered type. Every round stores the links, so
    a lost executor costs one round; the number of rounds grows with the logarithm
    of the longest path. Minima are combined before the shuffle, whatever the degree of a node.
    """
    a, b = links.columns
    edges = stored(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    last = signature(edges)
    while last[0]:
        both = edges.union(edges.select("v", "u"))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = signature(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
