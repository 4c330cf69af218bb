"""The memory tables as views over base tables, in SQL that Spark and DuckDB share.

@S is the string type, @SHA(x) the hex SHA-256 of a text, @B(x) its bytes. Base tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The clock of all queries; operators take it as a parameter. The questions (view `queries`) are a fixture: QUESTIONS, and the
#: first six words of each benchmark item, since whole items are no questions. What they are asked of is whole tables.
NOW = 1735689600

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "memories": """
SELECT doc_id AS memory_id, source AS project, concat('sess-', CAST(doc_id % 97 AS @S)) AS session_id, text AS summary,
  concat(lang, ' ', source) AS tags, CAST(1704067200 + doc_id * 60 AS BIGINT) AS created_at
FROM {documents}""",
    "memory_meta": """
SELECT d.doc_id AS memory_id,
  CASE WHEN l.quality = 1 THEN 0.8E0 WHEN l.quality = 0 THEN 0.3E0 ELSE 0.5E0 END AS importance,
  CASE WHEN d.doc_id % 13 = 0 THEN 'user' ELSE 'project' END AS scope,
  CASE d.doc_id % 8 WHEN 0 THEN 'fact' WHEN 1 THEN 'fact' WHEN 2 THEN 'preference' WHEN 3 THEN 'error_solution' WHEN 4 THEN 'procedural'
    WHEN 5 THEN 'inference' WHEN 6 THEN 'architecture' ELSE 'session' END AS kind,
  CASE WHEN d.doc_id % 3 = 0 THEN concat(CAST(2019 + d.doc_id % 6 AS @S), '-0', CAST(1 + d.doc_id % 9 AS @S), '-1', CAST(d.doc_id % 10 AS @S)) END AS event_time,
  CASE WHEN d.doc_id % 17 = 0 THEN 'tenant_a' ELSE 'local' END AS namespace,
  CASE d.doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'untrusted' ELSE 'medium' END AS trust_tier,
  CASE WHEN d.doc_id % 19 = 0 THEN 'pii' WHEN d.doc_id % 23 = 0 THEN 'phi' ELSE 'internal' END AS classification,
  CASE WHEN d.doc_id % 19 = 0 AND d.doc_id % 2 = 0 THEN 'granted' WHEN d.doc_id % 23 = 0 THEN 'denied' END AS consent_state,
  CASE WHEN d.doc_id % 29 = 0 THEN CAST(1735689600 + (d.doc_id % 3 - 1) AS BIGINT) END AS expires_at,
  (d.doc_id % 31 = 0) AS legal_hold,
  CASE WHEN l.toxic = 1 THEN CAST(1730000000 AS BIGINT) END AS tombstoned_at,
  CASE WHEN d.doc_id = 12 THEN CAST(100 AS BIGINT) WHEN d.doc_id % 5 = 0 AND d.doc_id > 0 THEN CAST((d.doc_id - d.doc_id % 2) / 2 AS BIGINT) END AS parent_memory_id,
  CASE WHEN d.doc_id % 37 = 0 THEN 'ret-90d' END AS retention_policy_id,
  CASE WHEN d.doc_id % 6 = 0 THEN CAST(1733000000 + d.doc_id AS BIGINT) END AS trust_last_validated_at,
  CASE WHEN d.doc_id % 6 = 0 THEN CAST(d.doc_id % 9 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS trust_ref_count,
  CASE d.doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'stable' WHEN 2 THEN 'draft' END AS maturity
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id WHERE d.doc_id % 11 <> 10""",
    "sessions": """
SELECT concat('conv-', CAST(conv_id AS @S)) AS session_id, concat('src', CAST(conv_id % 20 AS @S)) AS project,
  CAST(1704067200 + conv_id * 3600 AS BIGINT) AS started_at,
  CASE WHEN conv_id % 3 = 0 THEN CAST(1704067200 + conv_id * 3600 + 1800 AS BIGINT) END AS ended_at, (conv_id % 5 = 0) AS compressed
FROM (SELECT DISTINCT conv_id FROM {conversations}) c""",
    "observations": """
SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS observation_id, concat('conv-', CAST(conv_id AS @S)) AS session_id,
  concat('src', CAST(conv_id % 20 AS @S)) AS project, CASE role WHEN 'user' THEN 'Bash' WHEN 'assistant' THEN 'Edit' ELSE 'Read' END AS tool,
  CASE WHEN role = 'user' THEN text END AS input, CASE WHEN role <> 'user' THEN text END AS output,
  CAST(1704067200 + conv_id * 3600 + turn * 60 AS BIGINT) AS created_at
FROM {conversations}""",
    "memory_embeddings": "SELECT vec_id AS memory_id, 'fixture-64' AS model, 64 AS dim, embedding, label FROM {embeddings}",
    "memory_edges": """
SELECT o_orderkey AS edge_id, c.c_mktsegment AS project, CAST(o_orderkey % 1000 AS BIGINT) AS memory_id, c.c_name AS source,
  CASE o_orderkey % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'current priority' ELSE 'placed' END AS relation,
  CASE o_orderkey % 3 WHEN 0 THEN o.o_orderstatus WHEN 1 THEN o.o_orderpriority ELSE concat('Clerk ', CAST(o_orderkey % 50 AS @S)) END AS target,
  CASE WHEN o_orderkey % 7 <> 0 THEN substr(CAST(o.o_orderdate AS @S), 1, 10) END AS valid_from,
  CASE WHEN o_orderkey % 10 = 0 THEN '1999-01-01' END AS valid_until,
  CAST(1704067200 + o_orderkey AS BIGINT) AS observed_at, CAST(o_orderkey % 101 AS DOUBLE) / 100.0E0 AS confidence
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "injection_events": "SELECT event_id, CAST(user_id AS BIGINT) AS memory_id, event_id % 10 AS rank_pos, event_type AS query, ts AS created_ts FROM {events} WHERE event_type IN ('view', 'click')",
    "memory_feedback": """
SELECT event_id, CAST(user_id AS BIGINT) AS memory_id, event_type AS signal,
  CASE event_type WHEN 'error' THEN -1.0E0 WHEN 'signup' THEN 0.25E0 ELSE 0.5E0 END AS weight, ts AS created_ts
FROM {events} WHERE event_type IN ('purchase', 'signup', 'error')""",
    "blobs": "SELECT @SHA(text) AS hash, CAST(max(@B(text)) AS BIGINT) AS orig_len, count(*) AS refcount, min(doc_id) AS first_doc_id FROM {documents} GROUP BY @SHA(text)",
    "ledger_events": "SELECT event_type AS namespace, event_id AS id, CAST(user_id AS BIGINT) AS memory_id, 'remember' AS op_type, props AS payload FROM {events}",
    "sweep_events": """
SELECT concat('src', CAST(conv_id % 20 AS @S)) AS project, 'dream' AS action, CASE WHEN conv_id % 3 = 0 THEN 'ok' ELSE 'error' END AS status,
  CAST(1704067200 + conv_id * 7200 AS BIGINT) AS subject_last_activity
FROM (SELECT DISTINCT conv_id FROM {conversations}) c""",
    "queries": "SELECT CAST(item_id AS BIGINT) AS query_id, array_to_string(list_slice(string_split(text, ' '), 1, 6), ' ') AS query FROM {benchmark} UNION ALL SELECT * FROM (VALUES @QUESTIONS) AS q(query_id, query)",
}
#: Views that Spark spells in another way.
SPARK = {"queries": "SELECT CAST(item_id AS BIGINT) AS query_id, array_join(slice(split(text, ' '), 1, 6), ' ') AS query FROM {benchmark} UNION ALL SELECT * FROM VALUES @QUESTIONS AS q(query_id, query)"}
#: Questions for every route; names and words are those of the views.
QUESTIONS = (
    "When did the status of Customer change in 2021?",
    "What happened to the thing before March 2022",
    "Which day was the one of 2020-03-12 with that",
    "How did Alice and Berlin relate to the thing",
    "the in of",
    "What is the status of Customer#000000001",
    "Show the current priority of Clerk 7",
    "Tell what Customer#000000004 placed after Customer#000000007",
    "reere onhe there hand and the wharea onion",
)
for _views in (VIEWS, SPARK):
    _views["queries"] = _views["queries"].replace("@QUESTIONS", ", ".join(f"(CAST({100001 + i} AS BIGINT), '{q}')" for i, q in enumerate(QUESTIONS)))


#: Tables of long texts, by their key.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table. One of long texts that comes in fewer splits than there are cores is small, and is dealt out by its key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, TEXTS[name])
    return df


class Tables:
    """Views and base tables of one folder: tables("memories")."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        if name in BASE:
            return base(self.spark, self.sf_dir, name)
        text = SPARK.get(name, VIEWS[name])
        text = re.sub(r"@SHA\((\w+)\)", r"sha2(\1, 256)", re.sub(r"@B\((\w+)\)", r"octet_length(\1)", text.replace("@S", "STRING") if "@SHA" not in text else re.sub(r"@S(?!HA)", "STRING", text)))
        used = {t: base(self.spark, self.sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)}
        return self.spark.sql(text, **used)


def duck(name: str) -> str:
    """The view as DuckDB SQL."""
    text = re.sub(r"@SHA\((\w+)\)", r"sha256(\1)", re.sub(r"@B\((\w+)\)", r"strlen(\1)", VIEWS[name]))
    return re.sub(r"\{(\w+)\}", r"\1", re.sub(r"@S(?!HA)", "VARCHAR", text))


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it needs as common table expressions; sql may begin with more of them, after WITH."""
    ctes = ",\n".join(f"{n} AS ({duck(n)})" for n in names)
    sql = sql.strip()
    if not ctes:
        return sql
    head = "WITH RECURSIVE " if sql.upper().startswith("WITH RECURSIVE ") else "WITH "
    rest = re.sub(r"(?i)\AWITH( RECURSIVE)?\s+", "", sql)
    return f"{head}{ctes}{',' if rest != sql else ''}\n{rest}"
