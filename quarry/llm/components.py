"""Connected components of a graph given as pairs, without gathering links anywhere.

Each round lets every node point to its smallest neighbour (large star), then small neighbours to the
smallest of them (small star), until nothing changes; the number of rounds grows with the logarithm
of the longest chain. Rounds end in a table in the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any direction, repeats and loops allowed) -> node, root (smallest node reachable).

    Nodes without links to others don't appear; neither do roots.
    """
    spark = links.sparkSession
    now, at = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        before = at
        now, at = stored(after)
        release(spark, before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == state or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
