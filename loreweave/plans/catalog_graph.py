"""Queries over the temporal graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions.text import normalize_graph_text, normalize_relation
from loreweave.operators import graph, relational
from loreweave.plans.registry import query

#: Edges with normalised ends, as SQL over the view memory_edges.
NORM = r"""n AS (
  SELECT *, array_to_string(list_transform(regexp_extract_all(source, '[\p{L}\p{N}]+'), lambda x: lower(x)), ' ') AS source_norm,
    replace(array_to_string(list_transform(regexp_extract_all(relation, '[\p{L}\p{N}]+'), lambda x: lower(x)), ' '), ' ', '_') AS relation_norm,
    array_to_string(list_transform(regexp_extract_all(target, '[\p{L}\p{N}]+'), lambda x: lower(x)), ' ') AS target_norm
  FROM memory_edges)"""
STATE = "(starts_with(relation_norm, 'current_') OR relation_norm IN ('is', 'status', 'state', 'role', 'location', 'works_at', 'lives_at', 'assigned_to', 'owner', 'primary'))"

#: Reconciled edges r.
RECONCILED = f"""{NORM},
d AS (SELECT *, row_number() OVER w AS rn, first_value(edge_id) OVER w AS keeper FROM n
  WINDOW w AS (PARTITION BY project, source_norm, relation_norm, target_norm, coalesce(valid_from, '') ORDER BY observed_at DESC, edge_id DESC)),
s AS (SELECT *, rn = 1 AND valid_until IS NULL AND {STATE} AS open FROM d),
k AS (SELECT *, first_value(edge_id) OVER w AS winner, first_value(target_norm) OVER w AS won, first_value(valid_from) OVER w AS won_from, first_value(observed_at) OVER w AS won_at FROM s
  WINDOW w AS (PARTITION BY project, source_norm, relation_norm, open ORDER BY observed_at DESC, edge_id DESC)),
r AS (SELECT edge_id, project, memory_id, source_norm, relation_norm, target_norm, source, relation, target, observed_at, confidence, valid_from,
  CASE WHEN rn > 1 THEN keeper WHEN open AND target_norm <> won THEN winner END AS superseded_by,
  CASE WHEN rn > 1 THEN 'duplicate' WHEN open AND target_norm <> won THEN 'current_state' END AS superseded_reason,
  CASE WHEN open AND target_norm <> won THEN coalesce(won_from, CAST(won_at AS VARCHAR)) ELSE valid_until END AS valid_until FROM k)"""
COLUMNS = ("edge_id", "project", "source_norm", "relation_norm", "target_norm", "valid_from", "valid_until", "superseded_by", "superseded_reason")


@query("memory_edges", sql=f"WITH {RECONCILED} SELECT {', '.join(COLUMNS)} FROM r")
def graph_reconcile(t):
    return graph.reconcile(t("memory_edges")).select(*COLUMNS)


@query("memory_edges", sql=f"WITH {RECONCILED} SELECT superseded_reason, count(*) AS n FROM r GROUP BY 1")
def reconcile_report(t):
    return graph.reconcile(t("memory_edges")).groupBy("superseded_reason").agg(F.count("*").alias("n"))


#: Insert order one edge at a time: the first later edge that outdates an active one.
@query("memory_edges", sql=f"""
WITH {NORM},
o AS (SELECT *, {STATE} AS cs, {STATE} AND valid_until IS NULL AS opens FROM n),
c AS (SELECT *, lead(edge_id) OVER (PARTITION BY project, source_norm, relation_norm, target_norm, coalesce(valid_from, '') ORDER BY edge_id) AS copy FROM o),
f AS (SELECT a.edge_id, min(b.edge_id) AS nxt FROM c a JOIN c b ON b.project = a.project AND b.source_norm = a.source_norm AND b.relation_norm = a.relation_norm
  AND b.edge_id > a.edge_id AND b.opens AND b.target_norm <> a.target_norm WHERE a.cs GROUP BY 1)
SELECT c.edge_id, CASE WHEN nxt IS NOT NULL AND (copy IS NULL OR nxt < copy) THEN nxt ELSE copy END AS superseded_by,
  CASE WHEN nxt IS NOT NULL AND (copy IS NULL OR nxt < copy) THEN 'current_state' WHEN copy IS NOT NULL THEN 'duplicate' END AS superseded_reason,
  CASE WHEN nxt IS NOT NULL AND (copy IS NULL OR nxt < copy) THEN coalesce(e.valid_from, CAST(e.observed_at AS VARCHAR)) ELSE c.valid_until END AS valid_until
FROM c LEFT JOIN f ON f.edge_id = c.edge_id LEFT JOIN n e ON e.edge_id = f.nxt""")
def graph_insert_reconcile(t):
    return graph.insert_all(t("memory_edges")).select("edge_id", "superseded_by", "superseded_reason", "valid_until")


@query("memory_edges", sql=f"WITH {NORM} SELECT edge_id, source_norm, relation_norm, target_norm FROM n")
def graph_normalize(t):
    e = t("memory_edges")
    return e.select("edge_id", normalize_graph_text(F.col("source")).alias("source_norm"), normalize_relation(F.col("relation")).alias("relation_norm"), normalize_graph_text(F.col("target")).alias("target_norm"))


@query("memory_edges", sql=f"""WITH {RECONCILED} SELECT edge_id, target_norm, observed_at FROM r WHERE (source_norm = 'customer 000000004' OR target_norm = 'customer 000000004') AND superseded_by IS NULL
ORDER BY observed_at DESC, edge_id DESC LIMIT 12""")
def entity_edges(t):
    e = graph.reconcile(t("memory_edges"))
    return graph.for_entity(e, "customer 000000004", 12).select("edge_id", "target_norm", "observed_at")


@query("memory_edges", sql=f"""WITH {NORM} SELECT edge_id, source_norm, target_norm FROM n
WHERE (valid_from IS NULL OR valid_from <= '1996-06-15') AND (valid_until IS NULL OR '1996-06-15' < valid_until)""")
def graph_as_of(t):
    return graph.normalized(t("memory_edges")).where(graph.as_of("1996-06-15")).select("edge_id", "source_norm", "target_norm")


@query("memory_edges", sql=f"""WITH {RECONCILED},
e AS (SELECT project, source_norm AS entity FROM r UNION SELECT project, target_norm FROM r),
c AS (SELECT project, count(*) AS n_nodes FROM e GROUP BY 1)
SELECT r.project, count(*) AS n_edges, count(*) FILTER (WHERE superseded_by IS NULL) AS n_active, count(*) FILTER (WHERE superseded_by IS NOT NULL) AS n_superseded, any_value(n_nodes) AS n_nodes, count(*) > 180 AS capped
FROM r JOIN c ON c.project = r.project GROUP BY 1""")
def graph_window_stats(t):
    return graph.window_stats(graph.reconcile(t("memory_edges")))


@query("memory_edges", sql=f"""WITH {NORM} SELECT edge_id, relation_norm, target_norm FROM n
WHERE contains(source_norm, 'priority') OR contains(replace(relation_norm, '_', ' '), 'priority') OR contains(target_norm, 'priority') ORDER BY observed_at DESC, edge_id DESC LIMIT 180""")
def graph_browse(t):
    return graph.browse(graph.normalized(t("memory_edges")), "priority").select("edge_id", "relation_norm", "target_norm")


@query("memory_edges", sql=f"""WITH {RECONCILED},
c AS (SELECT DISTINCT memory_id % 10 AS query_id, memory_id FROM r),
m AS (SELECT c.query_id, c.memory_id, r.source_norm, r.relation_norm, r.superseded_by IS NULL AS open FROM c JOIN r ON r.memory_id = c.memory_id),
shut AS (SELECT query_id, memory_id FROM m GROUP BY 1, 2 HAVING NOT bool_or(open)), o AS (SELECT DISTINCT query_id, source_norm, relation_norm FROM m WHERE open)
SELECT DISTINCT m.query_id, m.memory_id FROM m JOIN shut ON shut.query_id = m.query_id AND shut.memory_id = m.memory_id JOIN o ON o.query_id = m.query_id AND o.source_norm = m.source_norm AND o.relation_norm = m.relation_norm""")
def stale_candidates(t):
    e = graph.reconcile(t("memory_edges"))
    c = e.select((F.col("memory_id") % 10).alias("query_id"), "memory_id").distinct()
    return graph.stale(c, e).select("query_id", "memory_id")


@query("memory_edges", sql=f"""WITH {NORM}, e AS (SELECT edge_id, observed_at, unnest(list_distinct([source_norm, target_norm])) AS entity FROM n)
SELECT entity, edge_id FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY observed_at DESC, edge_id DESC) AS k FROM e) WHERE k <= 12""")
def newest_edges_by_entity(t):
    from loreweave.operators.search import top

    e = graph.endpoints(graph.normalized(t("memory_edges")))
    return top(e, 12, F.desc("observed_at"), F.desc("edge_id"), by="entity").select("entity", "edge_id")


@query(sql="""
SELECT doc_id, 'doc' || doc_id AS source, 'in_lang' AS relation, lang AS target, CAST(1.0 AS DOUBLE) AS confidence FROM documents""")
def relation_markers(t):
    text = F.concat(F.lit("a line\nRELATION: doc"), F.col("doc_id").cast("string"), F.lit(" | in_lang | "), F.col("lang"), F.lit("\nRELATION: a | b\nRELATION: x | not a relation! | y"))
    return graph.relation_markers(t("documents").select("doc_id", text.alias("text")), "text")


@query("memory_edges", sql=f"WITH {RECONCILED} SELECT count(*) AS n FROM r WHERE superseded_by IS NULL")
def active_edges(t):
    return graph.reconcile(t("memory_edges")).where("superseded_by IS NULL").agg(F.count("*").alias("n"))


@query("memory_edges", sql="SELECT edge_id, CASE WHEN edge_id % 4 = 0 THEN 'user_deleted' END AS superseded_reason FROM memory_edges")
def curate_edges(t):
    e = t("memory_edges").withColumn("superseded_reason", F.lit(None).cast("string")).select("edge_id", "superseded_reason")
    return relational.patched(e, e.where("edge_id % 4 = 0").select("edge_id", F.lit("user_deleted").alias("superseded_reason")), "edge_id")


#: A question about every hundredth customer, the names already known.
ASKED = r"""a AS (SELECT c_custkey AS query_id, 'current priority of ' || c_name AS query, replace(lower(c_name), '#', ' ') AS entity FROM customer WHERE c_custkey % 100 = 0),
w AS (SELECT *, list_distinct(list_transform(list_filter(regexp_extract_all(query, '[\p{L}\p{N}]+'), lambda x: length(x) >= 3), lambda y: lower(y))) AS ts FROM a)"""


def matches(c: str) -> str:
    return rf"len(list_intersect(ts, list_transform(list_filter(regexp_extract_all(replace({c}, '_', ' '), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3), lambda y: lower(y))))"


#: The scored edges of the questions: (query_id, memory_id, observed_at, path, score).
SCORED = f"""{RECONCILED}, {ASKED},
lv AS (SELECT *, unnest(list_distinct([source_norm, target_norm])) AS entity FROM r WHERE superseded_by IS NULL),
nw AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY observed_at DESC, edge_id DESC) AS kk FROM lv),
one AS (SELECT a.query_id, nw.* FROM nw JOIN a ON a.entity = nw.entity WHERE kk <= 12),
ends AS (SELECT query_id, unnest([source_norm, target_norm]) AS entity, observed_at, edge_id FROM one),
seen AS (SELECT e.query_id, e.entity, max(observed_at) AS o, max_by(edge_id, (observed_at, edge_id)) AS i FROM ends e JOIN a ON a.query_id = e.query_id WHERE e.entity <> a.entity GROUP BY 1, 2),
front AS (SELECT query_id, entity, i AS via FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, i DESC, entity) AS k FROM seen) WHERE k <= 16),
two AS (SELECT f.query_id, nw.*, f.via FROM nw JOIN front f ON f.entity = nw.entity WHERE kk <= 6),
b AS (SELECT *, [edge_id] AS path, 1.0 AS decay FROM one UNION ALL SELECT * EXCLUDE (via), [via, edge_id], 0.75 FROM two),
sc AS (SELECT b.query_id, memory_id, observed_at, path, round(({matches("relation")} * 3.0 + {matches("source")} + {matches("target")} + greatest(least(confidence, 1.0), 0.0)) * decay, 9) AS score FROM b JOIN w ON w.query_id = b.query_id)"""


def asked_customers(t):
    name = F.col("c_name")
    return t("customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("current priority of "), name).alias("query"), F.array(F.replace(F.lower(name), F.lit("#"), F.lit(" "))).alias("entities"))


@query("memory_edges", sql=f"""WITH {SCORED}, g AS (SELECT query_id, memory_id, max(score) AS score, max_by(observed_at, (score, observed_at)) AS observed_at FROM sc GROUP BY 1, 2)
SELECT query_id, memory_id, round(CAST(score AS DOUBLE), 6) AS score, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, observed_at DESC, memory_id) - 1 AS rank0 FROM g) WHERE rank0 < 20""")
def graph_recall(t):
    return graph.graph_recall(graph.reconcile(t("memory_edges")), asked_customers(t), 20).select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank0")


@query("memory_edges", sql=f"""WITH {SCORED}, g AS (SELECT query_id, memory_id, max((score, observed_at, -len(path), path)) AS b FROM sc GROUP BY 1, 2)
SELECT query_id, memory_id, b[4] AS path, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b[1] DESC, b[2] DESC, memory_id) - 1 AS rank0 FROM g) WHERE rank0 < 20""")
def graph_paths(t):
    return graph.graph_paths(graph.reconcile(t("memory_edges")), asked_customers(t), 20).select("query_id", "memory_id", "path", "rank0")
