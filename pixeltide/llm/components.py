"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregation (combined map-side) and one join on the node, so a node with very many links is handled by
Spark's skew splitting; every step's table is written to the shared folder and older ones are deleted.  The number of
steps grows with the logarithm of the component size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import release, written


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of any order to rows (node, root), root the least node; nodes without links do not appear."""
    now = written(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = _print(now)
    while seen[0]:
        large = written(_large_star(now), "links")
        small = written(_small_star(large), "links")
        print_ = _print(small)
        release(now, large)
        now, done = small, print_ == seen
        seen = print_
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
