"""The jobs as queries: each runs twice into one new folder, whose output is then read, with the SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import close_sessions, index_texts
from loreweave.functions.stem import stems_sql, tokens_sql
from loreweave.operators import fulltext
from loreweave.sources.shared import shared_folder


def twice(spark: SparkSession, job, source: str) -> str:
    """Runs a job and runs it again over the same input; returns the folder of its output."""
    folder = f"{shared_folder(spark)}/{job.__name__.rpartition('.')[2]}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, source, f"{folder}/output", f"{folder}/checkpoint")
    return f"{folder}/output"


def job1_index_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = twice(spark, index_texts, f"{sf_dir}/documents.parquet")
    rows = fulltext.postings(spark, out)
    return rows.select(F.col("memory_id").alias("doc_id"), F.col("length").alias("n_tokens"), "token", F.col("tf").alias("n"))


JOB1_SQL = f"""
WITH w AS (SELECT doc_id, {tokens_sql("text")} AS ws FROM (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)),
{stems_sql("st", "SELECT DISTINCT unnest(ws) AS token FROM w")}
SELECT doc_id, CAST(n_tokens AS INTEGER) AS n_tokens, stem AS token, CAST(count(*) AS INTEGER) AS n
FROM (SELECT doc_id, len(ws) AS n_tokens, unnest(ws) AS token FROM w) AS x JOIN st ON st.token = x.token GROUP BY doc_id, n_tokens, stem
"""


def job2_close_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = twice(spark, close_sessions, f"{sf_dir}/events.parquet")
    return close_sessions.read(spark, out)


JOB2_SQL = """
WITH e AS (SELECT event_id, ts, user_id, event_type FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g),
c AS (SELECT user_id, min(ts) AS started_at, max(ts) AS last_activity, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds,
  CAST(count(*) FILTER (WHERE event_type IN ('error')) AS BIGINT) AS n_failures, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY user_id, n)
SELECT *, CASE WHEN n_events >= 50 THEN 'idle,volume' ELSE 'idle' END AS reason, strftime(started_at, '%Y-%m-%d') AS day
FROM c WHERE epoch_ms(last_activity + INTERVAL 30 MINUTE) <= (SELECT epoch_ms(max(ts) - INTERVAL 10 MINUTE) FROM e)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_index_texts": job1_index_texts, "job2_close_sessions": job2_close_sessions}
ORACLES: dict[str, str] = {"job1_index_texts": JOB1_SQL, "job2_close_sessions": JOB2_SQL}
