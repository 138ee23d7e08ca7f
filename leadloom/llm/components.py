"""Connected components of a table of links, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import keep


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b: bigint) that is not its component's smallest node, the root.

    Alternates the large-star step (each node hands its larger neighbours to its smallest one) and the small-star step
    (each node hands itself and its smaller neighbours to the smallest); the number of rounds grows with the logarithm of
    the nodes. Minima are aggregates with map-side combine; the links of a node with very many are the hot side of an
    equi-join. Self-links and null ends are ignored; no links give no rows.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = keep(ends.distinct(), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large-star")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
