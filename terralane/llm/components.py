"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralane.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """Columns node and root for every node of ``links`` (a, b: longs): root is the least node it is joined to.

    Each round points the larger neighbours of a node at its least one, then its smaller ones. The least
    neighbour is an aggregate that is pre-summed before the shuffle, and the join back has one row a node on
    its other side, so a node with very many links is only one more aggregate row and a join that adaptive
    execution may split. Rounds end when every node but the roots has exactly one link, to its root; their
    number grows with the logarithm of the longest chain. Tables between rounds are written to the shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not _settled(edges):
        after = stored(_small_star(_large_star(edges)), "stars")
        discard(edges)
        edges = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _settled(edges: DataFrame) -> bool:
    """Is every node either always a root or the larger end of a single link?"""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("v"), F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
    return odd.isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "n")
    larger = edges.select(F.col("v").alias("n"), F.col("u").alias("x"))     # x > n
    return larger.join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
    joined = edges.join(least, F.col("u") == F.col("n")).select("u", "v", "m")
    hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
