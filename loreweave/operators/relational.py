"""Aggregates, anti joins and roll-ups over sessions, memories and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators.visibility import with_meta
from loreweave.sources.shared import cut


def sweep_candidates(sessions: DataFrame, observations: DataFrame, least: int, idle_before: int, limit: int) -> DataFrame:
    """Open sessions with many observations or none lately, the longest idle first, with the reason."""
    o = observations.groupBy("session_id").agg(F.count("*").alias("n_observations"), F.max("created_at").alias("_last"))
    out = sessions.where(~F.col("compressed")).join(o, "session_id").withColumn("last_activity", F.coalesce("_last", "ended_at", "started_at"))
    idle, volume = F.col("last_activity") <= idle_before, F.col("n_observations") >= least
    out = out.where(idle | volume).withColumn("reason", F.concat_ws(",", F.when(idle, "idle"), F.when(volume, "volume")))
    return out.select("session_id", "project", "started_at", "last_activity", "n_observations", "reason").orderBy("last_activity", "started_at", "session_id").limit(limit)


def project_summary(memories: DataFrame, sessions: DataFrame) -> DataFrame:
    """Memories and last activity of each project, the newest first."""
    s = sessions.select("session_id", "ended_at", "started_at")
    at = F.coalesce("ended_at", "started_at", "created_at")
    out = memories.join(s, "session_id", "left").groupBy("project").agg(F.count("*").alias("n_memories"), F.max(at).alias("last_activity"))
    return out.orderBy(F.desc("last_activity"), "project")


def dream_candidates(summary: DataFrame, sweep_events: DataFrame, due: int) -> DataFrame:
    """Projects idle since `due` that no successful dream has seen in their last state, the longest idle first."""
    done = sweep_events.where("action = 'dream' AND status = 'ok'").select(F.col("project").alias("_p"), "subject_last_activity")
    same = (F.col("project") == F.col("_p")) & (F.col("subject_last_activity") >= F.col("last_activity"))
    return summary.where(F.col("last_activity") <= due).join(done, same, "left_anti").orderBy("last_activity", "project")


def governance_inventory(memories: DataFrame, meta: DataFrame, now: int) -> DataFrame:
    rows = with_meta(memories.select("memory_id"), meta)
    return rows.groupBy("namespace", "classification", "consent_state").agg(
        F.count("*").alias("n"),
        F.count_if("legal_hold").alias("n_held"),
        F.count_if(F.col("tombstoned_at").isNotNull()).alias("n_deleted"),
        F.count_if(F.col("expires_at") <= now).alias("n_expired"),
        F.count_if(F.col("retention_policy_id").isNotNull()).alias("n_retained"),
    )


def session_history(sessions: DataFrame, memories: DataFrame, observations: DataFrame) -> DataFrame:
    """Sessions with the number of observations and the tags of their newest memory."""
    o = observations.groupBy("session_id").agg(F.count("*").alias("n"))
    m = memories.groupBy("session_id").agg(F.max_by("tags", F.struct("created_at", "memory_id")).alias("latest_tags"))
    out = sessions.join(o, "session_id", "left").join(m, "session_id", "left")
    return out.select("session_id", "project", "started_at", F.coalesce("n", F.lit(0)).alias("n_observations"), "latest_tags")


def score_adjustments(injections: DataFrame, feedback: DataFrame) -> DataFrame:
    """Times shown, positive and negative feedback of each memory that has either."""
    i = injections.groupBy("memory_id").agg(F.count("*").alias("n_shown"))
    w = F.col("weight")
    f = feedback.groupBy("memory_id").agg(F.sum(F.when(w > 0, w).otherwise(0.0)).alias("positive"), F.sum(F.when(w < 0, -w).otherwise(0.0)).alias("negative"))
    out = i.join(f, "memory_id", "full")
    return out.select("memory_id", F.coalesce("n_shown", F.lit(0)).alias("n_shown"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("positive", "negative")])


def reinforcement(positive, negative, shown):
    """What feedback makes of a score: from 0.2 to 1.6; memories shown five times or more without use lose a little."""
    unused = F.when((shown >= 5) & (positive - negative <= 0), F.least((shown - 4) * 0.015, F.lit(0.25))).otherwise(0.0)
    return F.greatest(F.least(1.0 + F.least(positive * 0.08, F.lit(0.45)) - F.least(negative * 0.12, F.lit(0.65)) - unused, F.lit(1.6)), F.lit(0.2))


def maturity(memories: DataFrame, injections: DataFrame, feedback: DataFrame, start: str = "draft") -> DataFrame:
    """Drafts shown three times become stable, and stable ones with feedback of 2 or more core, in one sweep."""
    shown = injections.groupBy("memory_id").agg(F.count("*").alias("n")).where("n >= 3").select("memory_id", F.lit(True).alias("_shown"))
    liked = feedback.groupBy("memory_id").agg(F.sum("weight").alias("w")).where("w >= 2.0").select("memory_id", F.lit(True).alias("_liked"))
    out = memories.select("memory_id").join(shown, "memory_id", "left").join(liked, "memory_id", "left")
    stable = (F.lit(start) == "draft") & F.col("_shown") | (F.lit(start) == "stable")
    return out.select("memory_id", F.when(F.coalesce(stable, F.lit(False)) & F.col("_liked"), "core").when(stable, "stable").otherwise(start).alias("maturity"))


def missing(rows: DataFrame, other: DataFrame, key: str = "memory_id") -> DataFrame:
    """Rows whose key the other table lacks."""
    return rows.join(other.select(key), key, "left_anti")


def keep_last(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Upsert: of the rows of a key the last in order stays."""
    return _one(rows, keys, [F.desc(c) for c in order])


def keep_first(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Insert or ignore: of the rows of a key the first in order stays."""
    return _one(rows, keys, [F.asc(c) for c in order])


def _one(rows: DataFrame, keys: list[str], order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """rows with the non-null values of a patch of the same key."""
    cols = [c for c in patch.columns if c != key]
    out = rows.join(patch.select(key, *[F.col(c).alias(f"_{c}") for c in cols]), key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).drop(*[f"_{c}" for c in cols])


def stratified(rows: DataFrame, by: str, n: int, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str = "memory_id") -> dict[str, DataFrame]:
    """The tables without the rows of purged memories."""
    return {name: df.join(gone.select(key), key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def governed_delete(memories: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """What becomes of asked memories: blocked by a legal hold, already gone, or deleted now."""
    state = F.when(F.col("legal_hold"), "blocked").when(F.col("tombstoned_at").isNotNull(), "gone").otherwise("deleted")
    return asked.join(memories, "memory_id").select("memory_id", state.alias("outcome"), F.when(state == "deleted", F.lit(now)).otherwise(F.col("tombstoned_at")).alias("tombstoned_at"))


def numbered(rows: DataFrame, column: str, first: int, *order: str) -> DataFrame:
    """rows with a column that counts from `first` in the order of the columns `order`; by ranges of them, not in one task."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return placed.join(F.broadcast(before), "_part").withColumn(column, (F.col("_before") + F.col("_place") + (first - 1)).cast("long")).drop("_part", "_place", "_before")
