"""Connected components of a table of links, by alternating star contraction, as joins and aggregations.

Every round points each node's larger neighbours (large star), then its smaller ones (small star), at the smallest node it
sees; the links end as stars around the smallest node of each component, after a number of rounds that grows with the
logarithm of the component's size. Smallest neighbours are partial aggregates in a written table, so the join back to a node
with very many links can be split. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import join_staged, stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-low")
    far = join_staged(both.where("b > a"), low, ["a"], "inner")
    return far.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = stage(down.groupBy("a").agg(F.min("b").alias("m")), "star-low")
    near = join_staged(down, low, ["a"], "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(low.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) -> (node, root): every linked node, roots included, with the smallest node it is connected to."""
    links = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
        large = stage(_large_star(links).distinct(), "links")
        links = stage(_small_star(large).distinct(), "links")
    stars = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
