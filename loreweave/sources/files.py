"""File sources and sinks: question sets as JSON, source trees, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = """question_id string, question_type string, question string, answer string, question_date string,
haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"""


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(path, multiLine=True)


def turns_of(questions: DataFrame) -> DataFrame:
    """(question_id, session_id, day, turn, role, content) of the questions' dated sessions."""
    s = questions.select("question_id", F.posexplode(F.arrays_zip(F.col("haystack_dates").alias("day"), F.col("haystack_sessions").alias("turns"))).alias("n", "s"))
    t = s.select("question_id", F.concat_ws("-", "question_id", "n").alias("session_id"), F.col("s.day").alias("day"), F.posexplode("s.turns").alias("turn", "t"))
    return t.select("question_id", "session_id", "day", "turn", "t.role", "t.content")


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.rs") -> DataFrame:
    """(path, text) of source files below a folder, without build and repository folders."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(~F.col("path").rlike("/(\\.git|target|node_modules)/"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 100) -> str:
    """A table of at most so many rows, for reports."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join('' if x is None else str(x) for x in r)} |\n" for r in rows)
