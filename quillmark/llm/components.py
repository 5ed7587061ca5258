"""Connected components of a table of links, by alternating large and small stars.

Every round hangs the larger neighbours of each node on the smallest (large star), then the node and its smaller
neighbours on the smallest of those (small star); rounds go on until no link changes, O(log^2 n) of them.  Links stay
distributed; each round is a table in the shared folder, so a lost executor costs one round at most.  A node of very
many links is no hot spot: minima are combined before the shuffle and joined by ``join_groups``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import join_groups, written


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("degree"))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; links has long columns a and b.  root is the smallest node reached.

    Links of a node to itself, repeated links and links with a null end say nothing.  No links give no rows.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    ends = written(ends.distinct(), "links")
    before, mark = None, _mark(ends)
    while mark != before and mark[0]:
        both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = join_groups(both, _least(both), "a", "degree", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        large = written(large.distinct(), "large-star")
        n = large.count()
        joined = join_groups(large, _least(large), "a", "degree", n)
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(joined.where("b = least").select("a", "b"))
        ends = written(small.distinct(), "small-star")
        before, mark = mark, _mark(ends)
    return ends.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ends.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
