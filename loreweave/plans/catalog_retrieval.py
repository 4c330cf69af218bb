"""Queries over retrieval: vectors, words, dates, routes, fusion, and the whole search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave.functions.stem import asked_sql, stems_sql, tokens_sql
from loreweave.functions.text import MULTI_HOP_CUES, QUESTION_WORDS, TEMPORAL_CUES, years
from loreweave.functions.vectors import folding_embedder, norm
from loreweave.operators import ann, fulltext, fusion, graph, knn, relational, search, visibility
from loreweave.plans import rerank, retrieve
from loreweave.plans.catalog_graph import RECONCILED
from loreweave.plans.catalog_tables import ADJUST, LOGS, MM, live
from loreweave.plans.catalog_text import event_terms_sql, graph_terms_sql
from loreweave.plans.registry import LIVE, query
from loreweave.sources.shared import cut, scratch
from loreweave.sources.views import NOW

VECTORS = "memory_embeddings"


def query_vectors(t):
    return t(VECTORS).where("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "embedding")


NEAREST = """
WITH v AS (SELECT memory_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM memory_embeddings WHERE memory_id IN (SELECT memory_id FROM memories)),
p AS (SELECT q.memory_id AS query_id, v.memory_id, round(list_cosine_similarity(q.e, v.e), 9) AS s FROM v q JOIN v ON q.memory_id <> v.memory_id WHERE q.memory_id % 100 = 0)
SELECT query_id, memory_id, round(s, 6) AS similarity, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) - 1 AS rank0 FROM p) WHERE rank0 < 10"""


@query(VECTORS, "memories", sql=NEAREST)
def knn_topk(t):
    v = t(VECTORS).join(t("memories").select("memory_id"), "memory_id", "left_semi")
    q = v.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    return knn.nearest(v, q, 10).select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), "rank0")


@query(VECTORS, "memories", sql=NEAREST)
def indexed_knn(t):
    """The same from a stored index of cells, read until all hits are certain."""
    v = t(VECTORS).join(t("memories").select("memory_id"), "memory_id", "left_semi")
    path = scratch(t.spark, "vectors")
    ann.build(v.select("memory_id", "embedding"), path, cells=24)
    q = v.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "embedding")
    return ann.search(t.spark, path, q, 10, most_rounds=None).select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), "rank0")


@query(VECTORS, sql="SELECT memory_id, round(sqrt(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 5) AS norm, CAST(1.0 AS DOUBLE) AS unit FROM memory_embeddings")
def vector_norms(t):
    v = t(VECTORS)
    return v.select("memory_id", F.round(norm(F.col("embedding")), 5).alias("norm")).join(knn.unit_vectors(v).select("memory_id", F.round(norm(F.col("embedding")), 5).alias("unit")), "memory_id")


@query("memories", VECTORS)
def embedding_backfill(t):
    return knn.backfill(t("memories"), t(VECTORS), "fixture-64", folding_embedder(64))


#: Stemmed full text: the tokens of memories and queries, their stems, postings, document counts and scores.
BM25 = f"""w AS (SELECT memory_id, {tokens_sql("concat_ws(' ', project, session_id, summary, tags)")} AS ws FROM memories),
raw AS (SELECT DISTINCT query_id, unnest({asked_sql("query")}) AS token FROM queries),
{stems_sql("st", "SELECT unnest(ws) AS token FROM w UNION SELECT token FROM raw")},
tot AS (SELECT count(*) AS n, avg(len(ws)) AS avg_len FROM w),
pst AS (SELECT memory_id, stem AS token, count(*) AS tf FROM (SELECT memory_id, unnest(ws) AS token FROM w) AS x JOIN st ON st.token = x.token GROUP BY 1, 2),
qt AS (SELECT DISTINCT query_id, stem AS token FROM raw JOIN st ON st.token = raw.token),
df AS (SELECT token, count(*) AS df FROM pst GROUP BY 1),
bm AS (SELECT query_id, p.memory_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg_len))) AS score
  FROM qt JOIN pst p ON p.token = qt.token JOIN df ON df.token = p.token JOIN w ON w.memory_id = p.memory_id CROSS JOIN tot GROUP BY 1, 2)"""


BEST = f"""WITH {LIVE}, {BM25}, r AS (SELECT query_id, bm.memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, created_at DESC, bm.memory_id DESC) - 1 AS rank0, score FROM bm JOIN live ON live.memory_id = bm.memory_id)
SELECT query_id, memory_id, rank0, round(score, 6) AS score FROM r WHERE rank0 < 10"""


@query(*MM, "queries", sql=BEST)
def bm25_search(t):
    return search.search_project(live(t), t("memories"), t("queries"), 10).select("query_id", "memory_id", "rank0", F.round("score", 6).alias("score"))


@query(*MM, "queries", sql=BEST)
def indexed_bm25_search(t):
    """The same from a stored index of three segments, the last of which takes out what the first two should not have had."""
    path, m = scratch(t.spark, "words"), search.memory_texts(t("memories"))
    fulltext.add(m.where("memory_id % 2 = 0"), path, 0)
    extra = m.select((-1 - F.col("memory_id")).alias("memory_id"), "text").where("memory_id % 5 = 0")
    fulltext.add(m.where("memory_id % 2 = 1").unionByName(extra), path, 1)
    fulltext.remove(extra, path, 2)
    asked = search.query_tokens(t("queries"))
    return search.search_project(live(t), t("memories"), t("queries"), 10, ready=fulltext.ready(t.spark, path, asked)).select("query_id", "memory_id", "rank0", F.round("score", 6).alias("score"))


@query(*MM, "queries", sql=f"""WITH {LIVE}, {BM25}, r AS (SELECT DISTINCT qt.query_id, live.memory_id, created_at FROM qt JOIN pst ON pst.token = qt.token JOIN live ON live.memory_id = pst.memory_id)
SELECT query_id, memory_id, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, memory_id DESC) - 1 AS rank0 FROM r) WHERE rank0 < 10""")
def global_recency_search(t):
    return search.search_everywhere(live(t), t("queries"), 10).select("query_id", "memory_id", "rank0")


@query("memories", "queries", sql=f"""WITH {BM25}, need AS (SELECT query_id, count(*) AS need FROM qt GROUP BY 1)
SELECT qt.query_id, pst.memory_id FROM qt JOIN pst ON pst.token = qt.token JOIN need ON need.query_id = qt.query_id GROUP BY 1, 2, need HAVING count(*) = need""")
def match_all_words(t):
    return search.match_all(t("memories"), t("queries"))


def chunks(t):
    return t("memories").select("memory_id", "created_at", F.col("project").alias("title"), F.col("summary"))


@query(*MM, "queries", sql=f"""WITH {LIVE}, q AS (SELECT query_id, {event_terms_sql('query')} AS ts FROM queries),
s AS (SELECT query_id, memory_id, created_at, len(list_filter(ts, lambda x: contains(lower(project || ' ' || summary), x))) AS score FROM live, q)
SELECT query_id, memory_id, CAST(score AS INTEGER) AS score, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, memory_id DESC) - 1 AS rank0 FROM s WHERE score > 0) WHERE rank0 < 10""")
def chunk_parent_recall(t):
    return search.chunk_parents(chunks(t), live(t), t("queries"), 10).select("query_id", "memory_id", "score", "rank0")


@query(*MM, "queries", sql="""
WITH y AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(query, '[0-9]{4}')) AS year FROM queries), h AS (SELECT DISTINCT query_id, m.memory_id, created_at FROM memories m JOIN memory_meta mm ON mm.memory_id = m.memory_id JOIN y ON contains(event_time, year) AND starts_with(event_time, year) WHERE year BETWEEN '1900' AND '2099')
SELECT query_id, memory_id, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, memory_id DESC) - 1 AS rank0 FROM h) WHERE rank0 < 20""")
def event_year_recall(t):
    asked = t("queries").select("query_id", F.explode(F.array_distinct(years(F.col("query")))).alias("year"))
    return search.by_year(t("memories"), t("memory_meta"), asked, 20).select("query_id", "memory_id", "rank0")


@query(*MM, "queries", sql=f"""
WITH d AS (SELECT m.memory_id, created_at, kind, event_time, {event_terms_sql("concat_ws(' ', summary, tags)")} AS terms, coalesce(try_cast(event_time AS DATE), make_date(CAST(left(event_time, 4) AS INT), 1, 1)) AS day, contains(concat_ws(' ', summary, tags), 'source:') AS linked
  FROM memories m JOIN memory_meta mm ON mm.memory_id = m.memory_id WHERE trim(event_time) <> '' ORDER BY created_at DESC, m.memory_id DESC LIMIT 512),
q AS (SELECT query_id, {event_terms_sql('query')} AS ts,
  CASE WHEN regexp_matches(query, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'day' WHEN contains(query, 'March 2022') THEN 'month' WHEN regexp_matches(query, '\\b20[0-9]{{2}}\\b') THEN 'year' END AS p,
  CASE WHEN regexp_matches(query, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(regexp_extract(query, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS DATE) WHEN contains(query, 'March 2022') THEN DATE '2022-03-01'
    WHEN regexp_matches(query, '\\b20[0-9]{{2}}\\b') THEN make_date(CAST(regexp_extract(query, '\\b20[0-9]{{2}}\\b') AS INT), 1, 1) END AS qd FROM queries),
h AS (SELECT query_id, memory_id, created_at, day, len(list_intersect(ts, terms)) AS n, len(list_intersect(ts, terms)) / len(ts) AS part, CASE WHEN kind = 'fact' THEN 4.0 ELSE 1.0 END + CASE WHEN linked THEN 2.0 ELSE 0.0 END AS bonus,
  CASE WHEN length(regexp_replace(event_time, '[^0-9]', '', 'g')) >= 8 THEN 1.0 ELSE 0.0 END AS exact,
  coalesce(greatest(CASE p WHEN 'day' THEN 8.0 - abs(date_diff('day', day, qd)) / 7.0 WHEN 'month' THEN 6.0 - (abs(year(qd) - year(day)) * 12 + abs(month(qd) - month(day))) WHEN 'year' THEN 4.0 - abs(year(qd) - year(day)) END, 0.0), 0.0) AS near
  FROM d, q WHERE len(list_intersect(ts, terms)) > 0),
s AS (SELECT *, n * 2.0 + part * 2.0 + bonus AS quality, n * 10.0 + part * 3.0 + bonus + exact + near AS base FROM h),
c AS (SELECT query_id, count(DISTINCT day) AS days FROM s GROUP BY 1),
z AS (SELECT s.*, base + CASE WHEN days > 1 THEN quality * 2.0 ELSE 0.0 END AS score FROM s JOIN c ON c.query_id = s.query_id)
SELECT query_id, memory_id, round(score, 5) AS score, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(quality, 9) DESC, created_at DESC, memory_id) - 1 AS rank0 FROM z) WHERE rank0 < 10""")
def temporal_event_score(t):
    hits = search.temporal_events(t("memories"), t("memory_meta"), t("queries"), 10, pool=512)
    return hits.select("query_id", "memory_id", F.round("score", 5).alias("score"), "rank0")


def any_sql(c: str, parts) -> str:
    return " OR ".join(f"contains({c}, '{p}')" for p in parts)


ENTITIES = f"""list_filter(list_filter(regexp_extract_all(query, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '^\\p{{Lu}}')), lambda y: lower(y) NOT IN ({", ".join(f"'{w}'" for w in QUESTION_WORDS)}))"""


@query("queries", sql=f"""
WITH f AS (SELECT query_id, query, lower(trim(query)) AS q, ' ' || lower(query) || ' ' AS p, len(list_distinct(list_transform({ENTITIES}, lambda x: lower(x)))) AS n_entities, len({event_terms_sql('query')}) AS n_terms FROM queries)
SELECT query_id, CAST(n_entities AS INTEGER) AS n_entities, CAST(n_terms AS INTEGER) AS n_terms, CASE WHEN starts_with(q, 'when ') OR {any_sql('q', TEMPORAL_CUES)} THEN 'temporal' WHEN {any_sql('p', MULTI_HOP_CUES)} OR n_entities >= 2 THEN 'multi_hop'
  WHEN n_entities = 0 AND n_terms <= 3 THEN 'open_domain' ELSE 'single_hop' END AS route FROM f""")
def query_route(t):
    from loreweave.functions.text import event_terms, named_entities

    f = retrieve.features(t("queries"))
    return f.select("query_id", F.size(named_entities(F.col("query"))).alias("n_entities"), F.size(event_terms(F.col("query"))).alias("n_terms"), "route")


@query("queries", sql=r"""SELECT query_id, list_distinct(list_filter(regexp_extract_all(query, '\b(\d{4})\b', 1), lambda y: y BETWEEN '1900' AND '2099')) AS years FROM queries""")
def query_years(t):
    return t("queries").select("query_id", F.array_distinct(years(F.col("query"))).alias("years"))


@query("queries")
def query_variants(t):
    return retrieve.variants(retrieve.features(t("queries")))


def lists(t):
    """Three ranked lists for each session number, of all memories; each list is cut to its best 25."""
    m = t("memories").select((F.col("memory_id") % 97).alias("query_id"), "memory_id")
    parts = [(0, 1, F.col("memory_id") % 3 != 0, F.asc("memory_id")), (1, 2, F.col("memory_id") % 5 != 0, F.desc("memory_id")), (2, 3, F.col("memory_id") % 7 == 0, F.asc("memory_id"))]
    out = None
    for no, weight, some, order in parts:
        rows = search.top(m.where(some), 25, order).select("query_id", F.lit(no).alias("list_no"), F.lit(weight).alias("weight"), "memory_id", "rank0")
        out = rows if out is None else out.unionByName(rows)
    return out


LISTS = """mq AS (SELECT memory_id % 97 AS query_id, memory_id FROM memories),
ls AS (SELECT query_id, 0 AS list_no, 1 AS weight, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id) - 1 AS rank0 FROM mq WHERE memory_id % 3 <> 0
  UNION ALL SELECT query_id, 1, 2, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id DESC) - 1 FROM mq WHERE memory_id % 5 <> 0
  UNION ALL SELECT query_id, 2, 3, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id) - 1 FROM mq WHERE memory_id % 7 = 0),
fz AS (SELECT query_id, memory_id, sum(weight / (60.0 + rank0)) AS score, min(list_no * 1000000 + rank0) AS first FROM ls WHERE rank0 < 25 GROUP BY 1, 2),
fu AS (SELECT query_id, memory_id, round(CAST(score AS DOUBLE), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(score AS DOUBLE), 12) DESC, first, memory_id) - 1 AS rank0 FROM fz)"""


@query("memories", sql=f"WITH {LISTS} SELECT query_id, memory_id, score, rank0 FROM fu")
def rrf_fusion(t):
    return fusion.rrf(lists(t)).select("query_id", "memory_id", F.round("score", 9).alias("score"), "rank0")


def candidates(t):
    return fusion.rrf(lists(t)).join(visibility.with_meta(t("memories").select("memory_id", "created_at"), t("memory_meta")), "memory_id")


FACTS = f"""{LISTS}, x AS (SELECT fu.*, m.created_at, coalesce(importance, 0.5) AS importance, coalesce(kind, 'session') AS kind, coalesce(trust_tier, 'medium') AS trust_tier, coalesce(trust_ref_count, 0) AS refs, coalesce(maturity, 'draft') AS maturity, trust_last_validated_at AS validated
  FROM fu JOIN memories m ON m.memory_id = fu.memory_id LEFT JOIN memory_meta mm ON mm.memory_id = fu.memory_id)"""


def boosted(boost: str) -> str:
    return f"""WITH {FACTS}, b AS (SELECT query_id, memory_id, rank0 AS was, 1.0 / (60 + rank0) + {boost} AS s FROM x)
SELECT query_id, memory_id, round(s, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, was) - 1 AS rank0 FROM b"""


def ranks(rows):
    return rows.select("query_id", "memory_id", F.round("score", 8).alias("score"), "rank0")


@query(*MM, sql=boosted("0.01 * CASE trust_tier WHEN 'high' THEN 1.0 WHEN 'low' THEN -1.0 WHEN 'untrusted' THEN -2.0 ELSE 0.0 END"))
def tier_boost(t):
    return ranks(fusion.rerank(candidates(t), fusion.tier_boost(F.col("trust_tier"), 0.01)))


@query(*MM, sql=boosted(f"CASE WHEN refs > 0 AND validated IS NOT NULL THEN 0.02 * refs / (refs + 3.0) * pow(0.5, greatest({NOW} - validated, 0) / 86400.0 / 30.0) ELSE 0.0 END"))
def trust_boost(t):
    return ranks(fusion.rerank(candidates(t), fusion.trust_boost(F.col("trust_ref_count"), F.col("trust_last_validated_at"), NOW, 0.02, 30.0, 3.0)))


@query(*MM, sql=boosted(f"0.02 * greatest(least(importance, 1.0), 0.0) * CASE maturity WHEN 'core' THEN 1.3 WHEN 'stable' THEN 1.15 ELSE 1.0 END * pow(0.5, greatest({NOW} - created_at, 0) / 86400.0 / 200.0)"))
def activation_boost(t):
    return ranks(fusion.rerank(candidates(t), fusion.activation_boost(F.col("importance"), F.col("maturity"), F.col("created_at"), NOW, 0.02, 200.0)))


@query(*MM, sql=f"""WITH {FACTS},
o AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, CASE WHEN kind <> 'fact' THEN sum(CASE WHEN kind <> 'fact' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank0) END AS other FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (n <= 10 OR coalesce(other <= 4, false)) DESC, rank0) AS place FROM o)
SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY rank0) - 1 AS rank0 FROM k WHERE place <= 10""")
def narrative_reserve(t):
    return fusion.narrative_reserve(candidates(t), 10).select("query_id", "memory_id", "rank0")


@query("memories", sql=f"""WITH {LISTS} SELECT query_id, memory_id, CAST(CASE WHEN rank0 % 2 = 0 THEN rank0 // 2 ELSE count(*) OVER (PARTITION BY query_id) - 1 - (rank0 - 1) // 2 END AS INTEGER) AS place FROM fu""")
def u_shape(t):
    return fusion.u_shape(fusion.rrf(lists(t))).select("query_id", "memory_id", "place")


@query("memories", sql=f"""WITH {LISTS}, a AS (SELECT * FROM fu WHERE rank0 < 5 AND memory_id % 2 = 0), u AS (SELECT query_id, memory_id, 0 AS l, rank0 FROM a UNION ALL SELECT query_id, memory_id, 1, rank0 FROM fu WHERE rank0 < 10 AND (query_id, memory_id) NOT IN (SELECT (query_id, memory_id) FROM a))
SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY l, rank0) - 1 AS rank0 FROM u""")
def reanchor(t):
    f = fusion.rrf(lists(t))
    return fusion.reanchor(f.where("rank0 < 5 AND memory_id % 2 = 0"), f.where("rank0 < 10")).select("query_id", "memory_id", "rank0")


@query(*MM, *LOGS, sql=f"""{ADJUST}, r AS (
  SELECT m.memory_id, coalesce(kind, 'session') AS kind, (0.5 * CAST(m.memory_id % 10 AS DOUBLE) / 10 + 0.3 * pow(0.5, greatest({NOW} - m.created_at, 0) / 86400.0 / 14.0) + 0.2 * coalesce(importance, 0.5))
    * CASE kind WHEN 'fact' THEN 1.1 WHEN 'error_solution' THEN 1.2 WHEN 'preference' THEN 1.15 ELSE 1.0 END
    * greatest(least(1.0 + least(0.08 * coalesce(positive, 0), 0.45) - least(0.12 * coalesce(negative, 0), 0.65) - CASE WHEN coalesce(n_shown, 0) >= 5 AND coalesce(positive, 0) - coalesce(negative, 0) <= 0 THEN least(0.015 * (n_shown - 4), 0.25) ELSE 0 END, 1.6), 0.2) AS s
  FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id LEFT JOIN a ON a.memory_id = m.memory_id WHERE tombstoned_at IS NULL AND (expires_at IS NULL OR expires_at > {NOW}))
SELECT memory_id, kind, round(s, 6) AS score FROM r ORDER BY round(s, 9) DESC, memory_id LIMIT 25""")
def injection_rank(t):
    relevance = t("memories").select("memory_id", (F.col("memory_id") % 10 / 10).alias("relevance"))
    adjust = relational.score_adjustments(t("injection_events"), t("memory_feedback"))
    return retrieve.injection_rank(t("memories"), t("memory_meta"), relevance, adjust, NOW, 25).withColumn("score", F.round("score", 6))


def found(t, limit=10):
    c = retrieve.Config(now=NOW, limit=limit, tier_weight=0.002, trust_weight=0.004, supersession_weight=0.01, activation_weight=0.002)
    last = t(VECTORS).agg(F.max("memory_id")).first()[0] or 0  # each question has a vector, as long as there are more of them
    qv = t("queries").select("query_id", F.pmod("query_id", F.lit(last + 1)).alias("memory_id")).join(t(VECTORS).select("memory_id", "embedding"), "memory_id").select("query_id", "embedding")
    edges = graph.reconcile(cut(graph.normalized(t("memory_edges")), "normalized"))  # their names are normalised once
    return retrieve.hybrid_search(t("memories"), t("memory_meta"), edges, t("queries"), c, t(VECTORS), qv, chunks(t))


@query(*MM, "memory_edges", VECTORS, "queries")
def hybrid_search(t):
    return found(t)


#: Words and years alone, weighted by route, fused, and seen through visibility: the part of the search that SQL says briefly.
@query(*MM, "queries", sql=f"""WITH {LIVE}, {BM25},
ft AS (SELECT query_id, memory_id, rank0 FROM (SELECT query_id, bm.memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, created_at DESC, bm.memory_id DESC) - 1 AS rank0 FROM bm JOIN live ON live.memory_id = bm.memory_id) WHERE rank0 < 50),
y AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(query, '[0-9]{{4}}')) AS year FROM queries),
yh AS (SELECT DISTINCT query_id, m.memory_id, created_at FROM memories m JOIN memory_meta mm ON mm.memory_id = m.memory_id JOIN y ON starts_with(event_time, year) WHERE year BETWEEN '1900' AND '2099'),
yr AS (SELECT query_id, memory_id, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, memory_id DESC) - 1 AS rank0 FROM yh) WHERE rank0 < 50),
l AS (SELECT query_id, memory_id, 0 AS no, 1 AS w, rank0 FROM ft UNION ALL SELECT query_id, memory_id, 1, 2, rank0 FROM yr),
f AS (SELECT query_id, memory_id, CAST(sum(w / (60.0 + rank0)) AS DOUBLE) AS score, min(no * 1000000 + rank0) AS first FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, memory_id) - 1 AS rank0 FROM f)
SELECT r.query_id, r.memory_id, rank0, round(score, 8) AS score FROM r JOIN live ON live.memory_id = r.memory_id WHERE rank0 < 20""")
def lexical_year_search(t):
    asked = retrieve.features(t("queries")).withColumn("route", F.lit("temporal"))
    seen = live(t)
    two = {"fts": search.search_project(seen, t("memories"), asked, 50), "year": search.by_year(t("memories"), t("memory_meta"), asked.select("query_id", F.explode(F.array_distinct("years")).alias("year")), 50)}
    f = retrieve.fuse(two, asked).where("rank0 < 20").join(seen.select("memory_id"), "memory_id")
    return f.select("query_id", "memory_id", "rank0", F.round("score", 8).alias("score"))


@query(*MM, "memory_edges", VECTORS, "queries")
def reranked_search(t):
    return retrieve.reranked_search(lambda limit: found(t, limit), t("queries"), t("memories"), 10)


@query(*MM, "memory_edges", VECTORS, "queries")
def context_assembly(t):
    return retrieve.context(found(t), t("memories")).select("query_id", "memory_id", "place")


@query(*MM, "memory_edges", sql=f"""WITH {LISTS}, {RECONCILED},
c AS (SELECT query_id, fu.memory_id, rank0, row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(summary, '\\s+', ' ', 'g'))) ORDER BY rank0) AS copy FROM fu JOIN memories m ON m.memory_id = fu.memory_id WHERE rank0 < 10),
p AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY rank0) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS k FROM c WHERE copy = 1),
u AS (SELECT query_id, memory_id, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE k - 1 - (i - 1) // 2 END AS INTEGER) AS place FROM p),
parts AS (
  SELECT m.memory_id, 'memory' AS part, 0 AS n, CAST(m.memory_id AS VARCHAR) AS id, summary AS text, coalesce(kind, 'session') AS kind, event_time FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id
  UNION ALL SELECT memory_id, 'chunk', 1, 'mem:' || memory_id || ':overview', project, NULL, NULL FROM memories
  UNION ALL SELECT memory_id, 'edge', row_number() OVER (PARTITION BY memory_id ORDER BY confidence DESC, observed_at DESC, edge_id DESC), CAST(edge_id AS VARCHAR), source || ' ' || replace(relation, '_', ' ') || ' ' || target, NULL, NULL FROM r WHERE superseded_by IS NULL)
SELECT query_id, place, u.memory_id, part, CAST(n AS BIGINT) AS n, id, text, kind, event_time FROM u JOIN parts ON parts.memory_id = u.memory_id""")
def context_evidence(t):
    placed = retrieve.context(fusion.rrf(lists(t)).where("rank0 < 10"), t("memories"))
    c = chunks(t).withColumns({"ordinal": F.lit(1), "chunk_id": F.concat(F.lit("mem:"), F.col("memory_id").cast("string"), F.lit(":overview"))})
    return retrieve.evidence(placed, t("memories"), t("memory_meta").withColumn("source_ref", F.lit(None).cast("string")), c, graph.reconcile(t("memory_edges"))).drop("source_ref")


@query(*MM, "queries")
def multi_hop_search(t):
    once = lambda q: search.search_project(live(t), t("memories"), q, 5)

    def follow_up(q, hits):
        first = hits.where("rank0 = 0").join(t("memories").select("memory_id", "summary"), "memory_id")
        return q.join(first, "query_id").select("query_id", F.concat_ws(" ", "query", F.array_join(F.slice(F.split("summary", " "), 1, 3), " ")).alias("query"))

    rerank_all = lambda rows: retrieve.lexical_rerank(rows.withColumn("score", -F.col("rank0").cast("double")), t("queries"), t("memories")).select("query_id", "memory_id", "rank0")
    return retrieve.multi_hop(once, t("queries"), follow_up, 2, rerank_all)


@query(*MM, "queries", sql=f"""WITH e AS (SELECT DISTINCT memory_id, created_at, lower(unnest(regexp_extract_all(concat_ws(' ', summary, tags), '[\\p{{L}}\\p{{N}}]+'))) AS entity FROM memories),
a AS (SELECT DISTINCT query_id, lower(unnest({ENTITIES})) AS entity FROM queries), h AS (SELECT DISTINCT query_id, memory_id, created_at FROM e JOIN a ON a.entity = e.entity WHERE length(e.entity) >= 3)
SELECT query_id, memory_id, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, memory_id DESC) - 1 AS rank0 FROM h) WHERE rank0 < 10""")
def entity_recall(t):
    from loreweave.functions.text import named_entities

    asked = t("queries").select("query_id", F.explode(named_entities(F.col("query"))).alias("entity"))
    return search.by_entity(search.entity_tokens(t("memories")), t("memories"), asked, 10).select("query_id", "memory_id", "rank0")


@query(*MM, "queries", sql=f"""WITH {LIVE}, {BM25},
ft AS (SELECT query_id, memory_id, rank0 FROM (SELECT query_id, bm.memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, created_at DESC, bm.memory_id DESC) - 1 AS rank0 FROM bm JOIN live ON live.memory_id = bm.memory_id) WHERE rank0 < 50),
q AS (SELECT query_id, {event_terms_sql('query')} AS ts FROM queries)
SELECT ft.query_id, ft.memory_id, rank0, CAST(len(list_intersect(ts, {graph_terms_sql("concat_ws(' ', summary, tags)")})) AS INTEGER) AS n_shared, CAST(len(ts) AS INTEGER) AS n_terms
FROM ft JOIN q ON q.query_id = ft.query_id JOIN memories m ON m.memory_id = ft.memory_id LEFT JOIN memory_meta mm ON mm.memory_id = ft.memory_id
WHERE len(ts) > 0 AND coalesce(kind, '') <> 'inference' AND (kind = 'fact' OR contains(lower(tags), 'locomo') OR contains(lower(tags), 'source') OR contains(lower(tags), 'fact') OR contains(summary, '(as of '))
  AND NOT contains(lower(concat_ws(' ', summary, tags)), 'synthesized') AND NOT contains(lower(concat_ws(' ', summary, tags)), 'derived')""")
def source_facts(t):
    fts = search.search_project(live(t), t("memories"), t("queries"), 50)
    return search.source_facts(fts, t("queries"), t("memories"), t("memory_meta"))


@query(*MM, *LOGS, sql=f"""WITH p AS (SELECT max(memory_id) AS memory_id FROM memory_meta WHERE kind = 'preference'), a AS (SELECT m.memory_id, coalesce(kind, 'session') AS kind, coalesce(importance, 0.5) AS s FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id)
SELECT memory_id, kind, row_number() OVER (ORDER BY l, s DESC, memory_id) - 1 AS rank0 FROM (SELECT memory_id, kind, CASE WHEN memory_id IN (SELECT memory_id FROM p) THEN 0 ELSE 1 END AS l, s FROM a) ORDER BY l, s DESC, memory_id LIMIT 25""")
def profile_pinning(t):
    meta = t("memory_meta")
    profile = meta.where("kind = 'preference'").orderBy(F.desc("memory_id")).limit(1).select("memory_id", "kind")
    ranked = visibility.with_meta(t("memories").select("memory_id"), meta).select("memory_id", "kind", F.col("importance").alias("score"))
    return retrieve.pin_profile(ranked, profile, 25)


@query(*MM, "memory_edges", VECTORS, "queries")
def rerank_evidence(t):
    c = chunks(t).withColumn("ordinal", F.lit(1))
    return rerank.evidence(found(t), t("queries"), t("memories"), t("memory_meta"), c, graph.reconcile(t("memory_edges"))).select("query_id", "memory_id", "rank0", F.length("evidence").alias("n_chars"))


@query("memories", sql=f"""WITH {LISTS},
c AS (SELECT query_id, memory_id, CAST(memory_id * 7 % 5 AS DOUBLE) AS cheap, CAST(memory_id * 13 % 11 AS DOUBLE) AS dear FROM fu WHERE rank0 < 8),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cheap DESC, memory_id) AS i FROM c),
g AS (SELECT query_id FROM (SELECT query_id, max(CASE WHEN i = 1 THEN cheap END) - max(CASE WHEN i = 2 THEN cheap END) AS gap FROM o GROUP BY 1) WHERE gap < 1.0 ORDER BY gap, query_id LIMIT 40)
SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN e THEN dear ELSE cheap END DESC, memory_id) - 1 AS rank0, e AS escalated FROM (SELECT *, query_id IN (SELECT query_id FROM g) AS e FROM c)""")
def rerank_cascade(t):
    f = fusion.rrf(lists(t)).where("rank0 < 8").select("query_id", "memory_id")
    by = lambda a, m: f.withColumn("score", F.pmod(F.col("memory_id") * a, F.lit(m)).cast("double"))
    return rerank.cascade(by(7, 5), 1.0, lambda rows: rows.select("query_id", "memory_id", F.pmod(F.col("memory_id") * 13, F.lit(11)).cast("double").alias("score")), budget=40)


@query("memories", sql=f"""WITH {LISTS}, c AS (SELECT * FROM fu WHERE rank0 < 6), p AS (SELECT query_id, memory_id, rank0, CASE rank0 WHEN 3 THEN 0 WHEN 0 THEN 1 END AS told FROM c),
s AS (SELECT query_id, memory_id, 1.0 / (60 + rank0) + CASE WHEN told IS NULL THEN 0 ELSE 1.0 / (60 + told) END AS s, rank0 AS was FROM p)
SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(CAST(s AS DOUBLE), 12) DESC, was) - 1 AS rank0 FROM s""")
def fused_replies(t):
    f = fusion.rrf(lists(t)).where("rank0 < 6").select("query_id", "memory_id", "rank0")
    return rerank.fuse_replies(f, f.select("query_id", F.lit("Best: [4], 1, 99 then 4").alias("reply")).distinct()).select("query_id", "memory_id", "rank0")


@query(*MM, "queries", sql=f"""WITH q AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS i, {event_terms_sql('query')} AS ts FROM queries), k AS (SELECT count(*) AS n FROM q)
SELECT q.query_id, m.memory_id, CAST(len(list_intersect(ts, {event_terms_sql('summary')})) AS INTEGER) AS n_shared, CAST(len(ts) AS INTEGER) AS n_terms FROM memories m CROSS JOIN k JOIN q ON q.i = m.memory_id % k.n""")
def shared_terms(t):
    """Each memory with one of the questions, dealt out in turn."""
    q = t("queries").select("query_id", "query")
    n = q.count()
    at = q.withColumn("at", (F.row_number().over(Window.orderBy("query_id")) - 1).cast("long"))  # the questions, a small fixture
    pairs = t("memories").select("memory_id", F.pmod("memory_id", F.lit(n)).alias("at")).join(at.select("at", "query_id"), "at").drop("at")
    return rerank.shared_terms(pairs, q, t("memories")).select("query_id", "memory_id", "n_shared", "n_terms")
