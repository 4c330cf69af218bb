"""Metrics of question answering runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What question types test.
ABILITIES = {"single-session-user": "extraction", "single-session-assistant": "extraction", "single-session-preference": "extraction", "multi-session": "reasoning", "temporal-reasoning": "temporal", "knowledge-update": "update"}


def ability(question_type: Column) -> Column:
    out = F.lit("other")
    for k, v in ABILITIES.items():
        out = F.when(question_type == k, v).otherwise(out)
    return out


def accuracy(results: DataFrame, by: str) -> DataFrame:
    return results.groupBy(by).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct")).withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6))


def verdict(reply: Column) -> Column:
    """Strict: the first word is yes or no, else nothing."""
    first = F.lower(F.regexp_extract(F.trim(reply), r"^\W*(\w+)", 1))
    return F.when(first == "yes", True).when(first == "no", False)


def session_text(turns: DataFrame) -> DataFrame:
    """(session_id, text) of dated sessions' turns (session_id, day, turn, role, content)."""
    lines = turns.groupBy("session_id", "day").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "content").alias("line")))).alias("t"))
    return lines.select("session_id", F.concat(F.lit("Session Date: "), "day", F.lit("\n"), F.array_join(F.col("t.line"), "\n")).alias("text"))
