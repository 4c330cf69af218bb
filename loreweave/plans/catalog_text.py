"""Queries over texts: transcripts, chunks, consolidation, content types."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import dates
from loreweave.functions.text import event_terms, reflection_terms, source_terms, token_estimate, truncate_bytes, word_count
from loreweave.operators import anchors, blobs, compress, consolidate, relational
from loreweave.plans.registry import query
from loreweave.sources.shared import cut

NORM_TOKEN = """CASE WHEN strlen(x) > 5 AND ends_with(x, '''s') THEN left(x, length(x) - 2) WHEN strlen(x) > 6 AND ends_with(x, 'ing') THEN left(x, length(x) - 3)
  WHEN strlen(x) > 7 AND ends_with(x, 'edly') THEN left(x, length(x) - 4) WHEN strlen(x) > 5 AND ends_with(x, 'ed') THEN left(x, length(x) - 2)
  WHEN strlen(x) > 5 AND ends_with(x, 'es') THEN left(x, length(x) - 2) WHEN strlen(x) > 4 AND ends_with(x, 's') THEN left(x, length(x) - 1) ELSE x END"""


def in_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def event_terms_sql(c: str) -> str:
    from loreweave.functions.text import TEMPORAL_STOPWORDS

    tokens = f"list_transform(list_filter(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}'']+'), lambda x: length(x) >= 3), lambda y: lower(y))"
    return f"list_distinct(list_filter(list_transform({tokens}, lambda x: {NORM_TOKEN}), lambda z: z NOT IN ({in_list(TEMPORAL_STOPWORDS)})))"


def graph_terms_sql(c: str) -> str:
    tokens = f"list_transform(list_filter(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3), lambda y: lower(y))"
    return f"list_distinct(list_transform({tokens}, lambda x: {NORM_TOKEN}))"


def terms_sql(c: str) -> str:
    from loreweave.functions.text import TERM_STOPWORDS

    tokens = f"list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), lambda x: lower(x))"
    return f"list_sort(list_distinct(list_filter({tokens}, lambda x: strlen(x) >= 3 AND x NOT IN ({in_list(TERM_STOPWORDS)}))))"


SECTIONS = """s AS (
  SELECT *, '## ' || tool || chr(10) || coalesce('input: ' || input || chr(10), '') || coalesce('output: ' || output || chr(10), '') || chr(10) AS text FROM observations),
o AS (SELECT session_id, observation_id, project, created_at, text, row_number() OVER w AS ordinal, CAST(sum(strlen(text)) OVER w AS BIGINT) AS end_byte FROM s WINDOW w AS (PARTITION BY session_id ORDER BY created_at, observation_id ROWS UNBOUNDED PRECEDING))"""


@query("observations", sql=f"WITH {SECTIONS} SELECT session_id, observation_id, CAST(ordinal AS INTEGER) AS ordinal, end_byte - strlen(text) AS start_byte, end_byte FROM o")
def transcript_sections(t):
    return compress.transcript_sections(t("observations")).select("session_id", "observation_id", "ordinal", "start_byte", "end_byte")


@query("observations", sql=f"WITH {SECTIONS} SELECT session_id, sha256(string_agg(text, '' ORDER BY ordinal)) AS hash, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM o GROUP BY 1")
def transcripts(t):
    return compress.transcripts(t("observations")).select("session_id", F.sha2("transcript", 256).alias("hash"), F.octet_length("transcript").cast("long").alias("n_bytes"))


WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query("observations", sql=f"""WITH {SECTIONS},
d AS (SELECT *, {WORDS} AS ws, CASE WHEN {" OR ".join(f"contains(lower(text), '{w}')" for w in compress.HIGH_WORDS)} THEN 'high' WHEN len({WORDS}) > 160 THEN 'medium' ELSE 'low' END AS density FROM o),
e AS (SELECT *, CASE density WHEN 'high' THEN 90 WHEN 'medium' THEN 48 ELSE 24 END AS most FROM d)
SELECT 'mem:' || session_id || ':obs:' || observation_id AS chunk_id, density, end_byte - strlen(text) AS start_byte, end_byte,
  CAST(greatest((len(ws) * 4 + 2) // 3, 1) AS BIGINT) AS token_estimate, CASE WHEN len(ws) > most THEN array_to_string(ws[1:most], ' ') || '...' ELSE regexp_replace(regexp_replace(text, '^ +', ''), ' +$', '') END AS summary FROM e""")
def skim_chunks(t):
    return compress.skim_chunks(t("observations")).select("chunk_id", "density", "start_byte", "end_byte", "token_estimate", "summary")


@query("memories", "memory_meta", sql=f"""
WITH m AS (SELECT m.memory_id, m.summary AS text, coalesce(mm.kind, 'session') AS kind, coalesce(mm.importance, 0.5) AS importance, coalesce(trim(mm.event_time) <> '', false) AS dated
  FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id),
d AS (SELECT *, {WORDS} AS ws, CASE WHEN kind IN ({", ".join(f"'{k}'" for k in compress.HIGH_KINDS)}) OR dated OR importance >= 0.8 THEN 'high'
  WHEN kind IN ({", ".join(f"'{k}'" for k in compress.MEDIUM_KINDS)}) OR importance >= 0.6 THEN 'medium' ELSE 'low' END AS density FROM m),
e AS (SELECT *, CASE density WHEN 'high' THEN 90 WHEN 'medium' THEN 48 ELSE 24 END AS most FROM d)
SELECT 'mem:' || memory_id || ':overview' AS chunk_id, density, kind, CAST(greatest((len(ws) * 4 + 2) // 3, 1) AS BIGINT) AS token_estimate,
  CASE WHEN len(ws) > most THEN array_to_string(ws[1:most], ' ') || '...' ELSE regexp_replace(regexp_replace(text, '^ +', ''), ' +$', '') END AS summary FROM e""")
def memory_overviews(t):
    meta = t("memory_meta").select("memory_id", "kind", "importance", "event_time")
    none = F.lit(None).cast("array<string>")
    m = t("memories").select("memory_id", "project", "session_id", "summary").join(meta, "memory_id", "left")
    m = m.withColumns({"importance": F.coalesce("importance", F.lit(0.5)) * 10, "facts": none, "procedures": none})
    return compress.memory_chunks(m, t("observations").limit(0)).select("chunk_id", "density", "kind", "token_estimate", "summary")


@query("observations", sql=f"""
WITH {SECTIONS}, m AS (SELECT row_number() OVER (ORDER BY session_id) AS memory_id, session_id FROM (SELECT DISTINCT session_id FROM o) AS x),
f AS (SELECT m.memory_id, ordinal, 'fact' AS kind, coalesce(input, output, '') AS text FROM m JOIN o ON o.session_id = m.session_id JOIN observations b ON b.observation_id = o.observation_id
  UNION ALL SELECT m.memory_id, ordinal + 100000, 'procedural', 'run ' || tool || ' ' || o.observation_id FROM m JOIN o ON o.session_id = m.session_id JOIN observations b ON b.observation_id = o.observation_id),
n AS (SELECT *, regexp_replace(regexp_replace(text, '^ +', ''), ' +$', '') AS summary, row_number() OVER (PARTITION BY memory_id ORDER BY ordinal) AS place, row_number() OVER (PARTITION BY memory_id, kind ORDER BY ordinal) AS i, {WORDS} AS ws FROM f)
SELECT 'mem:' || memory_id || CASE kind WHEN 'fact' THEN ':fact:' ELSE ':procedure:' END || i AS chunk_id, CAST(place AS INTEGER) AS ordinal, 'high' AS density, kind, summary, CAST(greatest((len(ws) * 4 + 2) // 3, 1) AS BIGINT) AS token_estimate FROM n""")
def skim_facts(t):
    """The chunks of facts (what each observation says) and procedures (which tool it ran) of each session's memory."""
    o = t("observations")
    told = F.array_sort(F.collect_list(F.struct("created_at", "observation_id", F.coalesce("input", "output", F.lit("")).alias("fact"), F.concat(F.lit("run "), "tool", F.lit(" "), F.col("observation_id").cast("string")).alias("how"))))
    m = relational.numbered(o.groupBy("session_id", "project").agg(told.alias("s")), "memory_id", 1, "session_id")
    m = m.select("memory_id", "project", "session_id", F.lit("A session").alias("summary"), F.lit("session").alias("kind"), F.lit(5).alias("importance"), F.lit(None).cast("string").alias("event_time"), F.col("s.fact").alias("facts"), F.col("s.how").alias("procedures"))
    return compress.memory_chunks(m, o).where("chunk_id LIKE '%:fact:%' OR chunk_id LIKE '%:procedure:%'").select("chunk_id", "ordinal", "density", "kind", "summary", "token_estimate")


KEY = "translate(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("memories", sql=f"""
WITH m AS (SELECT memory_id, regexp_split_to_array(summary, ' ') AS ws FROM memories),
p AS (SELECT memory_id, ws[1:3] AS have, unnest(ws[4:]) AS x, generate_subscripts(ws[4:], 1) AS i FROM m),
f AS (SELECT memory_id, x, min(i) AS i FROM (SELECT memory_id, i, x, have, row_number() OVER (PARTITION BY memory_id, {KEY.format("x")} ORDER BY i) AS n FROM p)
  WHERE n = 1 AND NOT list_contains(list_transform(have, lambda y: {KEY.format("y")}), {KEY.format("x")}) GROUP BY memory_id, x)
SELECT m.memory_id, array_to_string(ws[1:3] || coalesce((SELECT list(x ORDER BY i) FROM f WHERE f.memory_id = m.memory_id), []), '|') AS facts FROM m""")
def coverage_merge(t):
    words = F.split("summary", " ")
    facts = compress.merged_facts(F.slice(words, 1, 3), F.slice(words, 4, 1 << 30))
    return t("memories").select("memory_id", F.array_join(facts, "|").alias("facts"))


@query(sql=f"SELECT doc_id, CAST(len({WORDS}) AS INTEGER) AS n_words, CAST(greatest((len({WORDS}) * 4 + 2) // 3, 1) AS BIGINT) AS n_tokens FROM documents")
def token_estimates(t):
    return t("documents").select("doc_id", word_count(F.col("text")).alias("n_words"), token_estimate(F.col("text")).alias("n_tokens"))


@query(sql="""
WITH c AS (SELECT doc_id, text, list_max(list_filter(range(0, 61), lambda n: strlen(left(text, n)) <= 60)) AS n FROM documents)
SELECT doc_id, CASE WHEN strlen(text) <= 60 THEN text ELSE left(text, n) || '… [truncated]' END AS text FROM c""")
def truncated_texts(t):
    return t("documents").select("doc_id", truncate_bytes(F.col("text"), 60).alias("text"))


def commands(t):
    """The observations as commands and edits: three commands in two forms, every fourth of which fails."""
    i = F.col("observation_id")
    bad = F.when(F.pmod(i, F.lit(4)) == 0, F.concat(F.lit("compiling\nerror: "), F.coalesce("output", "input", F.lit("build failed")))).otherwise("ok")
    tool = F.when(F.pmod(i, F.lit(5)) == 1, "Edit").when(F.pmod(i, F.lit(5)) == 3, "Write").otherwise("Bash")
    said = F.when(tool == "Bash", F.concat(F.element_at(F.array(F.lit("make"), F.lit("cargo"), F.lit("pytest")), (F.pmod(i, F.lit(3)) + 1).cast("int")), F.when(F.pmod(i, F.lit(2)) == 0, " all").otherwise(" one")))
    return t("observations").select("session_id", "observation_id", "created_at", tool.alias("tool"), said.otherwise(F.concat(F.lit("src/"), F.pmod(i, F.lit(6)).cast("string"), F.lit(".rs"))).alias("input"), bad.alias("output"))


@query("observations")
def correction_mining(t):
    return compress.mine_corrections(commands(t))


@query("observations", sql=f"""WITH {SECTIONS}, x AS (SELECT o.session_id, o.project, string_agg(text, '' ORDER BY ordinal) AS t, count(*) AS n, array_to_string(list_sort(list(DISTINCT tool)), ' ') AS tags
  FROM o JOIN observations b ON b.observation_id = o.observation_id GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN strlen(t) > 48000 THEN list_max(list_filter(range(12000, 48001), lambda i: strlen(left(t, i)) <= 48000)) END AS cut FROM x)
SELECT session_id, project, 'Session of ' || n || ' observations in ' || project || chr(10) || chr(10) || CASE WHEN cut IS NULL THEN t ELSE left(t, cut) || '… [truncated]' END AS summary, tags, CAST(5 AS INTEGER) AS importance FROM k""")
def local_compression(t):
    return compress.local_compression(t("observations"))


@query(sql=f"SELECT doc_id, CAST(len({event_terms_sql('text')}) AS INTEGER) AS n_event_terms, array_to_string({terms_sql('text')}[1:8], ' ') AS signature FROM documents")
def text_terms(t):
    return t("documents").select("doc_id", F.size(event_terms(F.col("text"))).alias("n_event_terms"), F.array_join(F.slice(reflection_terms(F.col("text")), 1, 8), " ").alias("signature"))


@query("memories", sql=f"""
WITH s AS (SELECT memory_id, array_to_string({terms_sql('summary')}[1:8], ' ') AS signature FROM memories)
SELECT signature, list_sort(list(memory_id)) AS memory_ids FROM s WHERE signature <> '' GROUP BY 1 HAVING count(*) > 1""")
def near_dup_signatures(t):
    return consolidate.signature_groups(t("memories"))


def kinds(t):
    return t("memories").join(t("memory_meta").select("memory_id", "kind"), "memory_id").where(F.col("kind").isin(*consolidate.KINDS))


@query("memories", "memory_meta", sql=f"""
WITH m AS (SELECT m.memory_id, kind, {terms_sql('summary')} AS ts FROM memories m JOIN memory_meta mm ON mm.memory_id = m.memory_id WHERE kind IN ({in_list(consolidate.KINDS)})),
c AS (SELECT kind, ts, min(memory_id) AS memory_id FROM m WHERE len(ts) > 0 GROUP BY 1, 2),
p AS (SELECT a.memory_id AS a, b.memory_id AS b, len(list_intersect(a.ts, b.ts)) AS n, len(a.ts) AS na, len(b.ts) AS nb FROM c a JOIN c b ON a.kind = b.kind AND a.memory_id < b.memory_id
  WHERE least(len(a.ts), len(b.ts)) >= 0.5 * greatest(len(a.ts), len(b.ts)) AND len(a.ts) > 0)
SELECT a, b, round(n / (na + nb - n), 6) AS jaccard FROM p WHERE n / (na + nb - n) >= 0.5""")
def similar_pairs(t):
    return consolidate.similar_pairs(kinds(t)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("memories", "memory_meta", sql=f"""
WITH m AS (SELECT m.memory_id, kind, {terms_sql('summary')} AS ts FROM memories m JOIN memory_meta mm ON mm.memory_id = m.memory_id WHERE kind IN ({in_list(consolidate.KINDS)}))
SELECT memory_id, kind, min(memory_id) OVER (PARTITION BY kind, ts) AS class_id FROM m WHERE len(ts) > 0""")
def term_classes(t):
    return consolidate.term_classes(kinds(t))


@query("memories", "memory_meta")
def greedy_groups(t):
    return consolidate.greedy_groups(kinds(t))


@query("memories", sql=f"""
WITH s AS (SELECT memory_id, unnest({terms_sql('summary')}) AS term FROM memories), g AS (SELECT term, list_sort(list(memory_id))[1:6] AS memory_ids FROM s WHERE strlen(term) >= 4 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 18)
SELECT min(term) AS term, memory_ids FROM g GROUP BY 2 ORDER BY 1 LIMIT 50""")
def synthesis_groups(t):
    return consolidate.synthesis_groups(t("memories"), groups=50)


LOG = r"""regexp_matches(x, '^[0-9]{4}-|[ ](INFO|WARN|ERROR|DEBUG|TRACE)[ \t]|\[(INFO|WARN|ERROR|DEBUG|TRACE)\]')"""
DETECT = f"""
WITH l AS (SELECT *, list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '') AS ls FROM c),
k AS (SELECT *, len(list_filter(ls, lambda x: starts_with(x, '@@'))) AS hunks, len(list_filter(ls, lambda x: regexp_matches(x, '^[-+@]'))) AS marks, len(list_filter(ls, lambda x: {LOG})) AS logs FROM l)
SELECT id, CASE WHEN contains(text, chr(0)) THEN 'binary' WHEN regexp_matches(trim(text), '^[\\[{{]') AND json_valid(trim(text)) THEN 'json'
  WHEN regexp_matches(ltrim(coalesce(ls[1], '')), '^(@@ |--- |\\+\\+\\+ |diff )') OR (hunks > 0 AND marks >= 3 AND marks * 10 >= len(ls) * 6) THEN 'diff'
  WHEN len(ls) >= 2 AND logs * 2 >= len(ls) THEN 'log' WHEN length(text) > 0 AND (length(text) - length(translate(text, '{{}}();', ''))) / length(text) > 0.02 THEN 'code' ELSE 'text' END AS content_type FROM k"""


@query(sql=DETECT.replace("WITH l", "WITH c AS (SELECT page_id AS id, html AS text FROM pages UNION ALL SELECT -1 - event_id, props FROM events UNION ALL SELECT 1000000 + doc_id, text FROM documents), l"))
def content_detect(t):
    rows = t("pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")).unionByName(t("events").select((-1 - F.col("event_id")).alias("id"), F.col("props").alias("text")))
    rows = rows.unionByName(t("documents").select((1000000 + F.col("doc_id")).alias("id"), "text"))
    return rows.select("id", blobs.content_type(F.col("text")).alias("content_type"))


@query("blobs", sql="SELECT hash, orig_len, true AS intact FROM blobs")
def blob_round_trip(t):
    return blobs.load(blobs.compressed(blobs.store(t("documents")))).select("hash", F.octet_length("text").cast("long").alias("orig_len"), "intact")


@query(sql="""SELECT sha256(text) AS hash, max(strlen(text)) AS orig_len, true AS intact, true AS no_larger FROM (
  SELECT text FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT props FROM events) AS x WHERE text IS NOT NULL GROUP BY 1""")
def blob_packing(t):
    """Documents, pages and events packed with the dictionaries trained on them, and read back; none is larger than without one."""
    rows = t("documents").select("text").unionByName(t("pages").select(F.col("html").alias("text"))).unionByName(t("events").select(F.col("props").alias("text"))).where("text IS NOT NULL")
    stored = cut(blobs.store(rows).withColumn("content_type", blobs.content_type(F.col("data"))), "stored")
    known = cut(blobs.train_dictionaries(stored.select("content_type", "data", F.col("orig_len").alias("order"))).withColumn("trained_at", F.lit(1).cast("long")), "dictionaries")
    packed = cut(blobs.pack(stored, known), "packed")
    back = blobs.unpack(packed, known).select("hash", F.octet_length("text").cast("long").alias("orig_len"), "intact")
    return back.join(packed.select("hash", (F.octet_length("packed") <= F.col("plain")).alias("no_larger")), "hash")


@query("memory_meta", sql=r"""
SELECT memory_id, event_time, coalesce(try_cast(event_time AS DATE) IS NOT NULL AND regexp_full_match(event_time, '\d{4}-\d{2}-\d{2}'), false) AS valid,
  coalesce(try_cast(event_time AS DATE), CASE WHEN event_time IS NOT NULL THEN make_date(CAST(left(event_time, 4) AS INT), 1, 1) END) AS day FROM memory_meta""")
def event_dates(t):
    return t("memory_meta").select("memory_id", "event_time", dates.is_date_or_range(F.col("event_time")).alias("valid"), dates.event_date(F.col("event_time")).alias("day"))


@query("observations", sql=r"""
SELECT observation_id, CAST(len(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(input, output, ''), '[\p{L}\p{N}]+'), lambda x: lower(x)), lambda x: length(x) >= 4
  AND x NOT IN ('that', 'this', 'with', 'from', 'have', 'into', 'will', 'should', 'memory', 'session')))) AS INTEGER) AS n FROM observations""")
def source_span_terms(t):
    return t("observations").select("observation_id", F.size(source_terms(F.coalesce("input", "output", F.lit("")))).alias("n"))


#: The source file of a part: a function with its name in a comment and a string, and a structure.
HEAD = ("// } ", "\npub fn part_", "(x: i32) -> i32 {\n  let s = \"{ ", " }}\"; /* { */ if x > 1 { return 2; }\n  x\n}", "\nstruct P", " { a: i32 }\n")


@query(sql=rf"""
WITH p AS (SELECT p_partkey AS k, '{HEAD[0]}' || p_name AS a, '{HEAD[1][1:]}' || p_partkey || '{HEAD[2]}' || p_name || '{HEAD[3]}' AS f, '{HEAD[4][1:]}' || p_partkey || '{HEAD[5][:-1]}' AS s FROM part)
SELECT 'src/' || k || '.rs' AS path, 'function' AS kind, 'part_' || k AS name, strlen(a) + 1 AS start_byte, strlen(a) + 1 + strlen(f) AS end_byte, sha256(trim(regexp_replace(f, '\s+', ' ', 'g'))) AS hash FROM p
UNION ALL SELECT 'src/' || k || '.rs', 'struct', 'P' || k, strlen(a) + strlen(f) + 2, strlen(a) + strlen(f) + 2 + strlen(s), sha256(trim(regexp_replace(s, '\s+', ' ', 'g'))) FROM p""")
def code_symbols(t):
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit(HEAD[0]), "p_name", F.lit(HEAD[1]), key, F.lit(HEAD[2]), "p_name", F.lit(HEAD[3]), F.lit(HEAD[4]), key, F.lit(HEAD[5]))
    return anchors.symbols(t("part").select(F.concat(F.lit("src/"), key, F.lit(".rs")).alias("path"), text.alias("text"))).drop("shingles")


@query(sql=r"""
WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_]\w*', 0, 'a'))) AS name FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text FROM documents)) SELECT doc_id AS memory_id, name FROM w WHERE name IN ('the', 'and', 'von')""".replace(", 0, 'a'", ""))
def code_mentions(t):
    found = t.spark.createDataFrame([("a.rs", "the", "function"), ("a.rs", "and", "struct"), ("b.rs", "von", "enum")], "path string, name string, kind string")
    plain = t("memories").withColumn("summary", F.regexp_replace("summary", r"[^\x00-\x7F]", " "))
    return anchors.mentions(plain, found).select("memory_id", "name")


@query("observations")
def best_spans(t):
    """For what went into each session's first observation (or came out), as a whole, the section that it comes from."""
    s = compress.transcript_sections(t("observations"))
    facts = s.where("ordinal = 1").select("session_id", F.col("observation_id").alias("fact_id"), F.coalesce("input", "output").alias("fact"))
    return compress.best_span(F.col("fact"), s.join(facts, "session_id").select("fact_id", "fact", "text", "start_byte", "end_byte"))


@query()
def compression_dictionaries(t):
    rows = t("documents").select(blobs.content_type(F.col("text")).alias("content_type"), F.col("text").alias("data"), F.col("doc_id").alias("order"))
    return blobs.train_dictionaries(rows).select("content_type", F.octet_length("data").alias("n_bytes"))
