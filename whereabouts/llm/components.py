"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large(links: DataFrame) -> DataFrame:
    """Joins each node's larger neighbours to its smallest one."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Joins each node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links (a, b)`` but the roots; a root is the smallest node of its component.

    Rounds grow with the logarithm of the longest chain. Each round is a written table; the driver sees its count and
    checksum only. Self-links and repeated links do no harm; no links give no rows.
    """
    now = saved(links.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        sums = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sums[0] == 0 or tuple(sums) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(sums)
        now = saved(_small(_large(now)))
