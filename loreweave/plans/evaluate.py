"""Evaluation that can be stopped and goes on: questions answered and judged in parts, under a manifest of what was asked and how."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.evals import accuracy

RESULT = "question_id string, ability string, answer string, verdict boolean, part int"


class ManifestError(ValueError):
    """The folder has results of other questions or settings."""


def identity(questions: DataFrame, settings: dict) -> str:
    """A hash of the questions' content, in whatever order they come, and of the settings."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(c).alias("x")), {"ignoreNullFields": "false"}) for c in sorted(questions.columns)])
    n, mixed, total = questions.agg(F.count("*"), F.bit_xor(row), F.sum((row % 1000003).cast("long"))).first()
    return hashlib.sha256(json.dumps([n, mixed, total, settings], sort_keys=True).encode()).hexdigest()


def manifest(spark: SparkSession, folder: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("identity string").json(f"{folder}/manifest").first()
    except AnalysisException:  # a new folder
        return None
    return row.identity if row else None


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, ability, answer, verdict, part) of the parts that are done."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(RESULT).parquet(f"{folder}/results")
    except AnalysisException:  # no part is done yet
        return spark.createDataFrame([], RESULT)


def run(spark: SparkSession, questions: DataFrame, answer: Callable[[DataFrame], DataFrame], settings: dict, folder: str, parts: int = 10) -> DataFrame:
    """Answers what has no result yet, part by part, and returns all results.

    questions: question_id and more; answer(questions) gives (question_id, ability, answer, verdict), one row each. A question's
    part follows from a hash of its id. A part is written whole or not at all, so a run that was stopped goes on with the next
    part; a folder that other questions or settings were answered into is refused.
    """
    now = identity(questions, settings | {"parts": parts})
    before = manifest(spark, folder)
    if before is None:
        spark.createDataFrame([(now,)], "identity string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    elif before != now:
        raise ManifestError(f"{folder} has results of other questions or settings")
    dealt = questions.withColumn("part", F.pmod(F.xxhash64("question_id"), F.lit(parts)).cast("int"))
    done = {r.part for r in results(spark, folder).select("part").distinct().collect()}  # at most the number of parts
    for part in range(parts):
        if part not in done:
            told = answer(dealt.where(F.col("part") == part).drop("part")).select("question_id", "ability", "answer", "verdict", F.lit(part).alias("part"))
            told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/results")
    return results(spark, folder)


def report(done: DataFrame) -> DataFrame:
    """(ability, n, n_correct, accuracy) of results."""
    return accuracy(done.select("ability", F.coalesce("verdict", F.lit(False)).alias("correct")), "ability")
