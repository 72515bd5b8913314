"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import condensed, shuffles_removed, written


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Tie each node's larger (or its smaller) neighbours to its smallest one."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both.where("b < a") if small else both
    least = side.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    if small:
        moved = side.join(least, "a").select(F.col("b").alias("b"), F.col("least").alias("a"))
        moved = moved.unionByName(least.select(F.col("a").alias("b"), F.col("least").alias("a")))
    else:
        moved = side.where("b > a").join(least, "a").select("b", F.col("least").alias("a"))
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each component is one star: a node has one smaller neighbour and no other, or larger ones only."""
    ends = links.select(F.col("a").alias("node"), F.lit(0).alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(1).alias("up")))
    with shuffles_removed(links.sparkSession):
        return ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("up").alias("ups")).where("ups > 0 and n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches, as a written table; nodes without links are left out.

    Large-star and small-star rounds: each ties nodes to smaller neighbours until
    every component is one star.  Rounds grow with the logarithm of the nodes;
    their tables are removed.
    """

    def stars() -> DataFrame:
        now = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        while not _settled(now):
            now = written(_star(_star(now, False), True), "links")
        return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())

    return condensed(links.sparkSession, stars, "components")


def joined_components(root: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``root`` and of further ``links``."""
    if links.isEmpty():
        return root
    return components(root.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(links.select("a", "b")))
