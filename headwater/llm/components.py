"""Connected components of a link table, by alternating large-star and small-star rounds on DataFrames.

Links and components stay distributed: every round groups by node with map-side combination and
joins back, and is written to the shared folder. A hot centre is a skewed join side, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import discard, staged


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Links run from larger to smaller."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the root is the smallest node it is connected with.

    Nodes may be of any type that Spark orders. Links to itself, repeated and null links do no harm;
    no links give no rows. Rounds grow with the logarithm of the longest path.
    """
    current = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _finished(current):
        following = staged(_small_star(_large_star(current)))
        discard(current)
        current = following
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _finished(links: DataFrame) -> bool:
    """Whether every node has one link at most and is either a root or linked to one."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b").distinct())
    return ends.groupBy("node").agg(F.count("*").alias("ends")).where("ends > 1").isEmpty()
