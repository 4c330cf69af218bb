"""Weighted reciprocal rank fusion and the passes that re-rank what it gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.dates import half_life
from loreweave.operators.graph import stale
from loreweave.operators.search import top

# The fusion constant, and how often each route repeats each signal's list.
K = 60
SIGNALS = ("fts", "vector", "variant", "year", "temporal_event", "graph", "chunk")
WEIGHTS = {
    "temporal": (1, 1, 1, 2, 3, 0, 0),
    "multi_hop": (1, 2, 2, 1, 1, 3, 0),
    "single_hop": (2, 1, 0, 1, 1, 1, 0),
    "open_domain": (1, 2, 0, 1, 1, 1, 1),
}
TIERS = {"high": 1.0, "medium": 0.0, "low": -1.0, "untrusted": -2.0}
MATURITY = {"core": 1.3, "stable": 1.15}


def weight_of(route: Column, signal: str) -> Column:
    at = SIGNALS.index(signal)
    return reduce(lambda out, kv: F.when(route == kv[0], kv[1][at]).otherwise(out), WEIGHTS.items(), F.lit(0))


def rrf(lists: DataFrame) -> DataFrame:
    """(query_id, memory_id, score, rank0) from (query_id, list_no, weight, memory_id, rank0).

    Each list adds weight / (60 + rank0). Ties go by the first list that has the memory, then its rank there.
    """
    part = F.col("weight") / (K + F.col("rank0"))
    fused = lists.where("weight > 0").groupBy("query_id", "memory_id").agg(F.sum(part).alias("score"), F.min(F.struct("list_no", "rank0")).alias("first"))
    return top(fused, 1 << 30, F.desc(F.round("score", 12)), "first", "memory_id").drop("first")


def rerank(candidates: DataFrame, boost: Column) -> DataFrame:
    """Candidates (query_id, memory_id, rank0, ...) by 1 / (60 + rank0) and a boost; ties keep their order."""
    scored = candidates.withColumns({"score": 1.0 / (K + F.col("rank0")) + boost, "_was": F.col("rank0")})
    return top(scored, 1 << 30, F.desc(F.round("score", 12)), "_was").drop("_was")


def tier_boost(tier: Column, weight: float) -> Column:
    return weight * reduce(lambda out, kv: F.when(tier == kv[0], kv[1]).otherwise(out), TIERS.items(), F.lit(0.0))


def trust_boost(ref_count: Column, validated_at: Column, now: int, weight: float, half_life_days: float, saturation: float) -> Column:
    """References and recent validation, multiplied; without either nothing."""
    refs = ref_count / (ref_count + max(saturation, 1.0))
    age = F.greatest(F.lit(now) - validated_at, F.lit(0)) / 86400.0
    return F.coalesce(F.when(ref_count > 0, weight * refs * half_life(age, half_life_days)), F.lit(0.0))


def activation_boost(importance: Column, maturity: Column, created_at: Column, now: int, weight: float, half_life_days: float) -> Column:
    ripe = reduce(lambda out, kv: F.when(maturity == kv[0], kv[1]).otherwise(out), MATURITY.items(), F.lit(1.0))
    age = F.greatest(F.lit(now) - created_at, F.lit(0)) / 86400.0
    return weight * F.greatest(F.least(importance, F.lit(1.0)), F.lit(0.0)) * ripe * half_life(age, half_life_days)


def demote_stale(candidates: DataFrame, edges: DataFrame, weight: float) -> DataFrame:
    gone = stale(candidates.select("query_id", "memory_id"), edges).withColumn("_stale", F.lit(True))
    return rerank(candidates.join(gone, ["query_id", "memory_id"], "left"), F.when(F.col("_stale"), -weight).otherwise(0.0)).drop("_stale")


def narrative_reserve(candidates: DataFrame, limit: int) -> DataFrame:
    """At most `limit` per query; where there are more, the first max(2 * limit / 5, 1) that aren't facts are sure of a place."""
    w = Window.partitionBy("query_id")
    other = F.col("kind") != "fact"
    c = candidates.withColumns({"_n": F.count("*").over(w), "_other": F.when(other, F.sum(other.cast("int")).over(w.orderBy("rank0")))})
    c = c.withColumn("_sure", (F.col("_n") <= limit) | F.coalesce(F.col("_other") <= max(2 * limit // 5, 1), F.lit(False)))
    c = top(c.withColumn("_was", F.col("rank0")), limit, F.desc("_sure"), "_was")
    return top(c, limit, "_was").drop("_n", "_other", "_sure", "_was")


def u_shape(ranked: DataFrame) -> DataFrame:
    """Even ranks from the front, odd ones from the back: place of each memory in a context."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    r = F.col("rank0")
    return ranked.withColumn("place", F.when(r % 2 == 0, F.floor(r / 2)).otherwise(n - 1 - F.floor((r - 1) / 2)).cast("int"))


def reanchor(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """The narrow list, then what the wide one has besides."""
    new = wide.join(narrow.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti").select("query_id", "memory_id", F.lit(1).alias("_l"), F.col("rank0").alias("_r"))
    both = narrow.select("query_id", "memory_id", F.lit(0).alias("_l"), F.col("rank0").alias("_r")).unionByName(new)
    return top(both, 1 << 30, "_l", "_r", "memory_id").drop("_l", "_r")


def source_floor(candidates: DataFrame, lexical: DataFrame, limit: int) -> DataFrame:
    """Where candidates exceed the limit, the best lexical source facts (query_id, memory_id, n_shared, n_terms, rank0) come first.

    They need two shared terms, or the only one; clamp(limit / 5, 1, 5) places are theirs.
    """
    enough = (F.col("n_shared") >= 2) | ((F.col("n_shared") == 1) & (F.col("n_terms") == 1))
    best = top(lexical.where(enough).withColumnRenamed("rank0", "_fts"), min(max(limit // 5, 1), 5), F.desc("n_shared"), "_fts").select("query_id", "memory_id", F.col("rank0").alias("_floor"))
    many = F.count("*").over(Window.partitionBy("query_id")) > limit
    c = candidates.withColumn("_many", many).join(best, ["query_id", "memory_id"], "left").withColumn("_was", F.col("rank0"))
    first = F.when(F.col("_many"), F.col("_floor"))
    return top(c.withColumn("_first", F.coalesce(first, F.lit(1 << 30))), 1 << 30, "_first", "_was").drop("_many", "_floor", "_was", "_first")
