"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedframe.llm.common import cut_lineage, discard


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a and b, comparable and not null) that is not the least of its component.

    Alternates two steps until nothing changes: each node links its larger neighbours to its least one, then its smaller
    neighbours and itself to the least.  Both keep components and end in stars around the least node, after a number of rounds that
    grows with the logarithm of the size.  Hubs cost one partially aggregated minimum and a join that may be split.
    """
    pairs = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        old, large = pairs, cut_lineage(both.join(least, F.col("u") == F.col("k")).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        others = large.join(down.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        pairs = cut_lineage(others.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        discard(old, large)
