"""Connected components of a link table, with alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


def _settled(edges: DataFrame) -> bool:
    """True if every node has one edge at most, to a node that has none: a forest of stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | (F.col("up") >= 1) & (F.col("down") > 0))
    return odd.limit(1).count() == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node that has a link; the component is its smallest node.

    Links stay distributed: each step is an aggregate (combined before the shuffle) and a join, and each
    round is cut to the shared checkpoint folder. The number of rounds grows with the logarithm of the
    longest chain. Links of a node with itself and repeated links do no harm; null ends are ignored.
    """
    usable = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(usable.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _settled(edges):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionAll(edges.select("v", "u"))
        least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.join(least, "n").where((F.col("x") > F.col("n")) & (F.col("x") != F.col("m"))).select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", "m"))
        edges = cut(small.distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
