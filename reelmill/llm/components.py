"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.llm.common import checkpoint, fitted


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): root is the smallest node reachable from node.

    Only nodes with a link to another node come back. Each round points every
    neighbour at the smallest node next to it, first among the larger neighbours
    and then among the smaller ones, until all links are stars; rounds grow with
    the logarithm of the longest path. The driver sees one row of sums a round. Tables
    of a round are dealt over as many tasks as they have rows for.
    """
    stars = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    n, before = stars.count(), None
    while True:
        stars = fitted(stars, n)
        print_ = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if print_ == before or print_.n == 0:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        before, n = print_, print_.n
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fitted(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
        large = fitted(both.join(least, "u").where("v > u").select(F.col("v"), F.col("m").alias("u")).distinct(), n)
        down = fitted(large.groupBy("v").agg(F.min("u").alias("m")), n)
        small = (
            large.join(down, "v")
            .select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("s"))
            .select("s.v", "s.u")
            .where("v <> u")
            .distinct()
        )
        stars = checkpoint(small)
