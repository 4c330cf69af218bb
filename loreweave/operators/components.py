"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.sources.shared import cut, discard

#: Parts that the links of one node are dealt to.
PARTS = 8


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """links (a, b) with the m of their a from least (a, m). The links of a hub are dealt to PARTS tasks, each with the hub's m."""
    part = F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")
    every = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return links.withColumn("part", part).join(every, ["a", "part"]).drop("part")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b: long): component is the smallest node reachable.

    Each round moves links towards the smallest node and is written to the shared folder, so lineage stays short and a
    lost executor costs one round. Nodes without a link, self-links and nulls give no row; no links: no rows.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        now, before = cut(small.distinct(), "links"), now
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
