"""Connected components of a link table by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.staging import staged


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is linked with one smaller node that is linked with none smaller itself."""
    marks = edges.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return marks.groupBy("n").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or (low > 0 and top > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable, itself included) of every node in ``links``(a, b).

    Links with a null end or with equal ends are ignored. Every round is a handful of keyed sums and joins over the links,
    written to the shared folder; nothing is collected. The number of rounds grows with the logarithm of the longest path.
    """
    start = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = staged(start, "links")
    while not _is_stars(edges):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
