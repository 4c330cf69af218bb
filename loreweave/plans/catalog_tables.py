"""Queries over tables: reads, aggregates, governance, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions.hashing import canonical
from loreweave.functions.text import clamp_kind, normalize_namespace
from loreweave.operators import blobs, govern, relational, visibility
from loreweave.plans.registry import LIVE, query
from loreweave.sources.views import NOW
from loreweave.streaming import logs

MM = ("memories", "memory_meta")
LOGS = ("injection_events", "memory_feedback")


def live(t):
    return visibility.live(t("memories"), t("memory_meta"), "local", NOW)


@query(*MM, sql=f"WITH {LIVE} SELECT memory_id, project, created_at FROM live ORDER BY created_at DESC, memory_id DESC LIMIT 50")
def recent_live_memories(t):
    return visibility.recent(live(t), 50).select("memory_id", "project", "created_at")


@query(*MM, sql=f"WITH {LIVE} SELECT count(*) AS n_live, count(DISTINCT project) AS n_projects FROM live")
def live_count(t):
    return live(t).agg(F.count("*").alias("n_live"), F.count_distinct("project").alias("n_projects"))


@query(*MM, sql=f"WITH {LIVE} SELECT memory_id, project, created_at FROM live WHERE project = 'src3' ORDER BY created_at DESC, memory_id DESC LIMIT 20")
def recent_in_project(t):
    return visibility.recent(live(t), 20, "src3").select("memory_id", "project", "created_at")


@query(*MM, sql=f"WITH {LIVE} SELECT memory_id, project, created_at FROM live WHERE scope = 'user' ORDER BY created_at DESC, memory_id DESC LIMIT 25")
def scoped_recent(t):
    return visibility.recent_scoped(live(t), "user", 25, "src3").select("memory_id", "project", "created_at")


@query(*MM, sql="SELECT m.memory_id, m.project, m.created_at FROM memories m JOIN memory_meta mm ON mm.memory_id = m.memory_id WHERE mm.kind = 'fact' ORDER BY m.created_at DESC, m.memory_id DESC LIMIT 40")
def memories_by_kind(t):
    return visibility.by_kind(t("memories"), t("memory_meta"), "fact", 40).select("memory_id", "project", "created_at")


@query(*MM, sql="""
SELECT m.memory_id, coalesce(importance, 0.5) AS importance, coalesce(scope, 'project') AS scope, coalesce(kind, 'session') AS kind, coalesce(namespace, 'local') AS namespace,
  coalesce(trust_tier, 'medium') AS trust_tier, coalesce(classification, 'internal') AS classification, coalesce(legal_hold, false) AS legal_hold,
  CAST(coalesce(trust_ref_count, 0) AS BIGINT) AS trust_ref_count, event_time, consent_state, expires_at
FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id""")
def full_metadata(t):
    cols = ("memory_id", "importance", "scope", "kind", "namespace", "trust_tier", "classification", "legal_hold", "trust_ref_count", "event_time", "consent_state", "expires_at")
    return visibility.with_meta(t("memories"), t("memory_meta")).select(*cols)


@query(*MM, sql="""
SELECT coalesce(classification, 'internal') AS classification, (coalesce(classification, 'internal') NOT IN ('phi', 'pii') OR coalesce(consent_state = 'granted', false)) AS accepted, count(*) AS n
FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id GROUP BY 1, 2""")
def consent_gate(t):
    ok, bad = visibility.consent_gate(visibility.with_meta(t("memories"), t("memory_meta")))
    rows = ok.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return rows.groupBy("classification", "accepted").agg(F.count("*").alias("n"))


@query("memory_meta", sql="SELECT namespace, count(*) AS n FROM memory_meta WHERE namespace IN ('tenant_a', 'tenant_b') GROUP BY 1")
def allowed_namespaces(t):
    return visibility.allowed(t("memory_meta"), ["tenant_a", "tenant_b"]).groupBy("namespace").agg(F.count("*").alias("n"))


@query("memory_meta", sql="SELECT kind, count(*) AS n FROM memory_meta WHERE kind <> 'inference' GROUP BY 1")
def quarantine(t):
    return visibility.without_inference(t("memory_meta")).groupBy("kind").agg(F.count("*").alias("n"))


@query("ledger_events", sql="SELECT DISTINCT namespace FROM ledger_events")
def namespaces(t):
    return t("ledger_events").select("namespace").distinct()


@query(sql="""
SELECT source, CASE WHEN trim(lang) = '' THEN 'local' ELSE replace(trim(lang), ' ', '_') END AS namespace, CASE WHEN lower(trim(source)) IN ('fact', 'profile') THEN lower(trim(source)) ELSE 'session' END AS kind, count(*) AS n
FROM documents GROUP BY 1, 2, 3""")
def clamped_values(t):
    return t("documents").groupBy("source", normalize_namespace(F.col("lang")).alias("namespace"), clamp_kind(F.col("source")).alias("kind")).agg(F.count("*").alias("n"))


@query("memories", "sessions", sql="""
SELECT m.project, count(*) AS n_memories, max(coalesce(s.ended_at, s.started_at, m.created_at)) AS last_activity
FROM memories m LEFT JOIN sessions s ON s.session_id = m.session_id GROUP BY 1""")
def project_summary(t):
    return relational.project_summary(t("memories"), t("sessions"))


DUE = 1704067200 + 400 * 60


@query("memories", "sessions", "sweep_events", sql=f"""
WITH p AS (SELECT m.project, count(*) AS n_memories, max(coalesce(s.ended_at, s.started_at, m.created_at)) AS last_activity
  FROM memories m LEFT JOIN sessions s ON s.session_id = m.session_id GROUP BY 1)
SELECT * FROM p WHERE last_activity <= {NOW} AND NOT EXISTS (
  SELECT 1 FROM sweep_events e WHERE e.action = 'dream' AND e.status = 'ok' AND e.project = p.project AND e.subject_last_activity >= p.last_activity + 500000)""")
def dream_candidates(t):
    done = t("sweep_events").withColumn("subject_last_activity", F.col("subject_last_activity") - 500000)
    return relational.dream_candidates(relational.project_summary(t("memories"), t("sessions")), done, NOW)


IDLE = 1704067200 + 50 * 3600


@query("sessions", "observations", sql=f"""
WITH c AS (SELECT s.session_id, s.project, s.started_at, max(o.created_at) AS last_activity, count(*) AS n_observations
  FROM sessions s JOIN observations o ON o.session_id = s.session_id WHERE NOT s.compressed GROUP BY 1, 2, 3)
SELECT *, concat_ws(',', CASE WHEN last_activity <= {IDLE} THEN 'idle' END, CASE WHEN n_observations >= 6 THEN 'volume' END) AS reason
FROM c WHERE last_activity <= {IDLE} OR n_observations >= 6 ORDER BY last_activity, started_at, session_id LIMIT 50""")
def sweep_candidates(t):
    return relational.sweep_candidates(t("sessions"), t("observations"), 6, IDLE, 50)


@query("sessions", "observations", "memories", sql="""
SELECT s.session_id, s.project, s.started_at, (SELECT count(*) FROM observations o WHERE o.session_id = s.session_id) AS n_observations, CAST(NULL AS VARCHAR) AS latest_tags FROM sessions s""")
def session_history(t):
    return relational.session_history(t("sessions"), t("memories"), t("observations"))


@query("memories", sql="SELECT session_id, max_by(tags, created_at) AS latest_tags, count(*) AS n FROM memories GROUP BY 1")
def latest_tags(t):
    return t("memories").groupBy("session_id").agg(F.max_by("tags", F.struct("created_at", "memory_id")).alias("latest_tags"), F.count("*").alias("n"))


@query("sessions", sql="SELECT session_id, project, started_at FROM sessions ORDER BY started_at DESC, session_id LIMIT 30")
def session_list(t):
    return t("sessions").select("session_id", "project", "started_at").orderBy(F.desc("started_at"), "session_id").limit(30)


@query("observations", sql="SELECT session_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM observations GROUP BY 1")
def observation_counts(t):
    return t("observations").groupBy("session_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@query(*MM, sql=f"""
SELECT coalesce(namespace, 'local') AS namespace, coalesce(classification, 'internal') AS classification, consent_state, count(*) AS n,
  count(*) FILTER (WHERE legal_hold) AS n_held, count(*) FILTER (WHERE tombstoned_at IS NOT NULL) AS n_deleted,
  count(*) FILTER (WHERE expires_at <= {NOW}) AS n_expired, count(*) FILTER (WHERE retention_policy_id IS NOT NULL) AS n_retained
FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id GROUP BY 1, 2, 3""")
def governance_inventory(t):
    return relational.governance_inventory(t("memories"), t("memory_meta"), NOW)


ADJUST = """
WITH i AS (SELECT memory_id, count(*) AS n_shown FROM injection_events GROUP BY 1),
f AS (SELECT memory_id, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS positive, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS negative FROM memory_feedback GROUP BY 1),
a AS (SELECT coalesce(i.memory_id, f.memory_id) AS memory_id, coalesce(n_shown, 0) AS n_shown, coalesce(positive, 0.0) AS positive, coalesce(negative, 0.0) AS negative FROM i FULL JOIN f ON f.memory_id = i.memory_id)"""


@query(*LOGS, sql=f"{ADJUST} SELECT memory_id, n_shown, positive, negative FROM a")
def score_adjustments(t):
    return relational.score_adjustments(t("injection_events"), t("memory_feedback"))


@query(*LOGS, sql=f"""{ADJUST} SELECT memory_id, round(greatest(least(1.0 + least(0.08 * positive, 0.45) - least(0.12 * negative, 0.65)
  - CASE WHEN n_shown >= 5 AND positive - negative <= 0 THEN least(0.015 * (n_shown - 4), 0.25) ELSE 0 END, 1.6), 0.2), 6) AS multiplier FROM a""")
def reinforcement(t):
    a = relational.score_adjustments(t("injection_events"), t("memory_feedback"))
    return a.select("memory_id", F.round(relational.reinforcement(F.col("positive"), F.col("negative"), F.col("n_shown")), 6).alias("multiplier"))


@query("memories", *LOGS, sql="""
WITH s AS (SELECT memory_id FROM injection_events GROUP BY 1 HAVING count(*) >= 3), l AS (SELECT memory_id FROM memory_feedback GROUP BY 1 HAVING sum(weight) >= 2.0)
SELECT memory_id, CASE WHEN memory_id IN (SELECT memory_id FROM s) THEN CASE WHEN memory_id IN (SELECT memory_id FROM l) THEN 'core' ELSE 'stable' END ELSE 'draft' END AS maturity FROM memories""")
def maturity_promotion(t):
    return relational.maturity(t("memories"), t("injection_events"), t("memory_feedback"))


@query("memories", "memory_embeddings", sql="SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM memory_embeddings)")
def missing_embeddings(t):
    return relational.missing(t("memories"), t("memory_embeddings")).select("memory_id")


#: Edges of placed orders are every memory's at some sizes; those of the first twenty clerks are not.
@query("memories", "memory_edges", sql="SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM memory_edges WHERE target IN ('Clerk 1', 'Clerk 4', 'Clerk 7'))")
def memories_without_edges(t):
    return relational.missing(t("memories"), t("memory_edges").where(F.col("target").isin("Clerk 1", "Clerk 4", "Clerk 7"))).select("memory_id")


@query("blobs", sql="""
SELECT count(*) AS n_blobs, CAST(sum(orig_len) AS BIGINT) AS stored_bytes, CAST(sum(orig_len * refcount) AS BIGINT) AS referenced_bytes,
  round(1 - CAST(sum(orig_len) AS DOUBLE) / CAST(sum(orig_len * refcount) AS DOUBLE), 6) AS saved_ratio FROM blobs""")
def blob_dedup_stats(t):
    return blobs.stats(blobs.store(t("documents")))


@query("blobs", sql="SELECT hash, orig_len, refcount FROM blobs")
def blob_store(t):
    return blobs.store(t("documents")).drop("data")


@query("blobs", sql="""
WITH r AS (SELECT sha256(text) AS hash, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), l AS (SELECT b.hash, orig_len, greatest(refcount - coalesce(n, 0), 0) AS refcount FROM blobs b LEFT JOIN r ON r.hash = b.hash)
SELECT count(*) AS n_collected, CAST(sum(orig_len) AS BIGINT) AS bytes FROM l WHERE refcount <= 0""")
def blob_gc(t):
    released = t("documents").where("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"))
    return blobs.release(blobs.store(t("documents")), released)[1].agg(F.count("*").alias("n_collected"), F.sum("orig_len").alias("bytes"))


@query("memory_meta", sql=f"""
SELECT memory_id, CASE WHEN legal_hold THEN 'blocked' WHEN tombstoned_at IS NOT NULL THEN 'gone' ELSE 'deleted' END AS outcome,
  CASE WHEN NOT legal_hold AND tombstoned_at IS NULL THEN {NOW} ELSE tombstoned_at END AS tombstoned_at FROM memory_meta WHERE memory_id % 4 = 0""")
def governed_delete(t):
    return relational.governed_delete(t("memory_meta"), t("memory_meta").where("memory_id % 4 = 0").select("memory_id"), NOW)


@query("injection_events", sql="SELECT memory_id, query, rank_pos FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY event_id DESC) AS n FROM injection_events) WHERE n = 1")
def upsert_keep_last(t):
    return relational.keep_last(t("injection_events"), ["memory_id"], "event_id").select("memory_id", "query", "rank_pos")


@query("memory_meta", sql="SELECT memory_id, CASE WHEN memory_id % 6 = 0 THEN 'pinned' ELSE kind END AS kind, scope FROM memory_meta")
def patch_metadata(t):
    m = t("memory_meta").select("memory_id", "kind", "scope")
    return relational.patched(m, m.where("memory_id % 6 = 0").select("memory_id", F.lit("pinned").alias("kind")), "memory_id")


@query("memories", sql="SELECT project, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY memory_id) AS n FROM memories) WHERE n <= 3")
def stratified_sample(t):
    return relational.stratified(t("memories"), "project", 3, "memory_id").select("project", "memory_id")


@query("memories", "memory_edges", sql="""
SELECT 'memories' AS name, count(*) AS n FROM memories WHERE memory_id % 10 <> 0 UNION ALL SELECT 'memory_edges', count(*) FROM memory_edges WHERE memory_id % 10 <> 0 OR memory_id NOT IN (SELECT memory_id FROM memories)""")
def purge_cascade(t):
    left = relational.purge({"memories": t("memories"), "memory_edges": t("memory_edges")}, t("memories").where("memory_id % 10 = 0"))
    return left["memories"].agg(F.count("*").alias("n")).select(F.lit("memories").alias("name"), "n").unionByName(left["memory_edges"].agg(F.count("*").alias("n")).select(F.lit("memory_edges").alias("name"), "n"))


def entries(t):
    e = t("ledger_events")
    return e.select("namespace", "id", "memory_id", "op_type", F.when(F.col("id") % 3 == 0, "agent").alias("actor"), "payload", (F.lit(1704067200) + F.col("id")).cast("long").alias("created_at"))


@query("ledger_events", sql="SELECT namespace, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_broken, CAST(NULL AS BIGINT) AS first_broken FROM ledger_events GROUP BY 1")
def ledger_chain_verify(t):
    return govern.verify_chain(govern.build_chain(entries(t)))


@query("ledger_events", sql="""
SELECT namespace, count(*) AS n_entries, count(*) FILTER (WHERE id % 500 = 7) AS n_broken, min(id) FILTER (WHERE id % 500 = 7) AS first_broken FROM ledger_events GROUP BY 1""")
def ledger_tamper_evidence(t):
    chain = govern.build_chain(entries(t))
    return govern.verify_chain(chain.withColumn("payload", F.when(F.col("id") % 500 == 7, "forged").otherwise(F.col("payload"))))


@query("ledger_events", sql="SELECT namespace, max(id) AS id FROM ledger_events GROUP BY 1")
def ledger_tips(t):
    return govern.tips(govern.build_chain(entries(t))).select("namespace", "id")


#: The chain, one entry after another: (namespace, n, id, prev_hash, entry_hash).
CHAIN = """e AS (
  SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY id) AS n, '{"actor":' || CASE WHEN id % 3 = 0 THEN '"agent"' ELSE 'null' END || ',"created_at":' || (1704067200 + id)
    || ',"memory_id":' || coalesce(CAST(memory_id AS VARCHAR), 'null') || ',"namespace":' || to_json(namespace) || ',"op_type":' || to_json(op_type) || ',"payload":' || coalesce(to_json(payload), 'null') || ',"prev_hash":' AS body
  FROM ledger_events),
chain(namespace, n, id, prev_hash, entry_hash) AS (
  SELECT namespace, n, id, CAST(NULL AS VARCHAR), sha256(body || 'null}') FROM e WHERE n = 1
  UNION ALL SELECT e.namespace, e.n, e.id, c.entry_hash, sha256(e.body || '"' || c.entry_hash || '"}') FROM chain c JOIN e ON e.namespace = c.namespace AND e.n = c.n + 1)"""


@query("ledger_events", sql=f"WITH RECURSIVE {CHAIN} SELECT namespace, id, prev_hash, entry_hash FROM chain")
def ledger_entries(t):
    return govern.build_chain(entries(t)).select("namespace", "id", "prev_hash", "entry_hash")


@query("ledger_events", sql=f"""WITH RECURSIVE {CHAIN}, f AS (SELECT namespace, prev_hash, id, entry_hash, sha256('fork ' || id) AS other FROM chain WHERE id % 500 = 7)
SELECT namespace, prev_hash, [id, id + 1000000000] AS entry_ids, sha256(namespace || chr(10) || coalesce(prev_hash, '') || chr(10) || entry_hash || chr(10) || other) AS evidence_sha256 FROM f""")
def fork_evidence(t):
    """A second entry after what every entry with id % 500 = 7 follows."""
    chain = govern.build_chain(entries(t))
    other = chain.where("id % 500 = 7").withColumns({"entry_hash": F.sha2(F.concat(F.lit("fork "), F.col("id").cast("string")), 256), "id": F.col("id") + 1000000000})
    out = govern.fork_evidence(chain.unionByName(other))
    return out.select("namespace", "prev_hash", F.transform("entries", lambda e: e["id"]).alias("entry_ids"), "evidence_sha256")


@query("memory_meta", sql="""
WITH RECURSIVE up(memory_id, depth, ancestor_id, path) AS (
  SELECT memory_id, 1, parent_memory_id, [memory_id, parent_memory_id] FROM memory_meta WHERE parent_memory_id IS NOT NULL
  UNION ALL SELECT u.memory_id, u.depth + 1, m.parent_memory_id, list_append(u.path, m.parent_memory_id) FROM up u JOIN memory_meta m ON m.memory_id = u.ancestor_id
  WHERE m.parent_memory_id IS NOT NULL AND u.depth < 32 AND NOT list_contains(u.path, m.parent_memory_id))
SELECT memory_id, depth, ancestor_id FROM up""")
def lineage_parents(t):
    return govern.lineage(t("memory_meta"))


@query("memories", sql="""
SELECT memory_id, sha256('{"memory_id":' || memory_id || ',"project":"' || project || '","tags":"' || tags || '"}') AS hash FROM memories""")
def canonical_hash(t):
    return t("memories").select("memory_id", F.sha2(canonical(tags=F.col("tags"), project=F.col("project"), memory_id=F.col("memory_id")), 256).alias("hash"))


@query(sql="""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) AS last_activity, count(*) AS n_events FROM s GROUP BY user_id, n""")
def sessionize_idle_gap(t):
    out = logs.sessionize(t("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_activity")})


@query(sql="SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events GROUP BY 1")
def sync_dedup(t):
    twice = t("events").unionByName(t("events").where("event_id % 3 = 0"))
    return logs.import_once(twice).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query(sql="SELECT event_type, max(event_id) + 1 AS next_clock FROM events GROUP BY 1")
def next_lamport(t):
    return t("events").groupBy("event_type").agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next_clock"))


@query(sql="SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def events_after(t):
    return t("events").where("event_id > 500").select("event_id", "event_type").orderBy("event_id").limit(200)


@query(sql="""SELECT event_id, CASE event_id % 7 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE user_id * CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 ELSE 604800 END END AS seconds FROM events""")
def durations(t):
    """The users' numbers as durations of every unit, with blanks around, and as what is none."""
    unit = F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "w", "y", ""))), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return t("events").select("event_id", logs.duration_seconds(F.concat(F.lit(" "), F.col("user_id").cast("string"), unit, F.lit(" "))).alias("seconds"))


@query(sql="SELECT label, count(*) AS n, count(*) FILTER (WHERE vec_id % 3 = 0) AS n_correct, round(count(*) FILTER (WHERE vec_id % 3 = 0) / count(*), 6) AS accuracy FROM embeddings GROUP BY 1")
def accuracy_by_ability(t):
    from loreweave.operators.evals import accuracy

    return accuracy(t("embeddings").withColumn("correct", F.col("vec_id") % 3 == 0), "label")


@query("ledger_events", sql="SELECT namespace, 1 AS epoch, max(id) AS start_entry_id FROM ledger_events GROUP BY 1")
def ledger_epochs(t):
    chain = govern.build_chain(entries(t))
    none = t.spark.createDataFrame([], "namespace string, epoch int")
    return govern.new_epochs(chain, none, NOW).select("namespace", "epoch", "start_entry_id")
