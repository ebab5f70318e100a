"""Connected components of links, by stars that shrink to the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with a link: root is the smallest node of its component.

    Rounds of large and small stars: each node hands its neighbours to the smallest of them, until
    all components are stars around their smallest node. The number of rounds grows with the
    logarithm of the size, links stay in tables, and a hub's neighbours are combined before the
    shuffle.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpoint(e)
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = e.join(low, e["v"] == low["n"]).select(F.col("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(own, large["u"] == own["n"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.where("u <> v").union(own.select("n", "m")).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select("v", "v")).distinct()
