"""Ranked retrieval: routes, signals, fusion, re-ranking, visibility, for many questions at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.dates import half_life
from loreweave.functions.names import names_of
from loreweave.functions.text import event_terms, query_entities, route, years
from loreweave.operators import fusion, graph, knn, relational, search
from loreweave.operators.visibility import is_live, where_given, with_meta, without_inference
from loreweave.sources.shared import cut, cut_together


@dataclass(frozen=True)
class Config:
    """Weights of 0 leave a pass out.

    early_exit: a single-hop question whose best lexical hit holds all its terms is answered from words and graph alone.
    least_share: results that hold a smaller share of the question's terms are left out, so that nothing may be found.
    project: only its memories and edges are searched; None searches all.
    """

    now: int
    limit: int = 10
    namespace: str = "local"
    tier_weight: float = 0.0
    trust_weight: float = 0.0
    supersession_weight: float = 0.0
    activation_weight: float = 0.0
    half_life_days: float = 30.0
    saturation: float = 3.0
    project: str | None = None
    early_exit: bool = False
    least_share: float = 0.0

    @property
    def pool(self) -> int:
        return max(5 * self.limit, 50)


def features(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) with route, years, and the entities that graph look-ups start from, eight at most."""
    q = F.col("query")
    return queries.select("query_id", "query", route(q).alias("route"), years(q).alias("years"), names_of(q).alias("entities"))


def variants(queries: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, query): parts of questions that need several memories: each entity with up to four other terms, and pairs of entities."""
    q = F.col("query")
    ents = F.slice(query_entities(q), 1, 4)
    names = F.transform(ents, lambda e: F.lower(e))
    terms = F.slice(F.filter(event_terms(q), lambda t: ~F.array_contains(names, t)), 1, 4)
    own = F.transform(ents, lambda e: F.concat_ws(" ", e, F.array_join(terms, " ")))
    pairs = F.zip_with(F.slice(ents, F.lit(1), F.greatest(F.size(ents) - 1, F.lit(0))), F.slice(ents, F.lit(2), F.greatest(F.size(ents) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    hard = queries.where(F.col("route").isin("multi_hop", "temporal"))
    return hard.select("query_id", F.posexplode(F.slice(F.concat(own, pairs), 1, most)).alias("part", "query"))


def signals(memories: DataFrame, meta: DataFrame, edges: DataFrame, asked: DataFrame, pool: int, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, chunks: DataFrame | None = None, now: int = 0, namespace: str = "local", index=search.index, nearest=None, project: str | None = None) -> dict[str, DataFrame]:
    """Ranked lists (query_id, memory_id, rank0) by signal. Words and chunks see visible memories only, the others all; with a
    project all see its own only. Words are weighed by their counts in all memories either way.

    index(memories, asked) and nearest(vectors, query_vectors, k): what search.index and knn.nearest give, for instance from
    stored indexes.
    """
    own_memories = where_given(memories, project=project)
    seen = with_meta(own_memories, meta).where((F.col("namespace") == namespace) & is_live(now))
    # Questions and their parts (at most six) are searched at once: eight times the id, and 7 or the number of the part.
    parts = variants(asked).select((F.col("query_id") * 8 + F.col("part")).alias("query_id"), "query")
    both = cut(asked.select((F.col("query_id") * 8 + 7).alias("query_id"), "query").unionByName(parts), "variants")
    ready = index(memories, search.query_tokens(both).select("token"))
    own, part = F.floor(F.col("query_id") / 8).cast("long").alias("query_id"), F.pmod("query_id", F.lit(8))
    found = cut(search.search_project(seen, memories, both, pool, ready=ready), "words")
    out = {
        "fts": found.where(part == 7).select(own, *[c for c in found.columns if c != "query_id"]),
        "year": search.by_year(own_memories, meta, asked.select("query_id", F.explode(F.array_distinct("years")).alias("year")), pool),
        "temporal_event": search.temporal_events(own_memories, meta, asked, pool),
        "graph": graph.graph_recall(edges, asked, pool),
    }
    if vectors is not None and query_vectors is not None:
        vectors = vectors if project is None else vectors.join(own_memories.select("memory_id"), "memory_id", "left_semi")
        out["vector"] = nearest(vectors, query_vectors, pool) if nearest else knn.nearest(vectors, query_vectors, pool, include_self=True)
    if chunks is not None:
        out["chunk"] = search.chunk_parents(chunks, seen, asked.where("route = 'open_domain'"), pool)
    hits = found.where((part < 7) & (F.col("rank0") < max(pool // 2, 1))).select(own, "memory_id", (part * 1000 + F.col("rank0")).alias("at"))
    hits = hits.groupBy("query_id", "memory_id").agg(F.min("at").alias("at"))
    out["variant"] = search.top(hits, pool, "at", "memory_id")
    return out


def fuse(lists: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    routes = asked.select("query_id", "route")
    parts = [
        rows.select("query_id", "memory_id", "rank0").join(routes, "query_id").select("query_id", F.lit(i).alias("list_no"), fusion.weight_of(F.col("route"), name).alias("weight"), "memory_id", "rank0")
        for i, (name, rows) in enumerate(sorted(lists.items(), key=lambda kv: fusion.SIGNALS.index(kv[0])))
    ]
    return fusion.rrf(reduce(DataFrame.unionByName, parts))


def refine(candidates: DataFrame, memories: DataFrame, meta: DataFrame, edges: DataFrame, c: Config, facts_found: DataFrame | None = None) -> DataFrame:
    """The passes after fusion, in order: trust, tier, supersession, activation, quarantine, source-fact floor, narrative reserve, visibility.

    facts_found: what search.source_facts gives for the lexical hits.
    """
    facts = with_meta(memories.select("memory_id", "created_at"), meta)
    rows = candidates.join(facts, "memory_id")
    if c.trust_weight:
        rows = fusion.rerank(rows, fusion.trust_boost(F.col("trust_ref_count"), F.col("trust_last_validated_at"), c.now, c.trust_weight, c.half_life_days, c.saturation))
    if c.tier_weight:
        rows = fusion.rerank(rows, fusion.tier_boost(F.col("trust_tier"), c.tier_weight))
    if c.supersession_weight:
        rows = fusion.demote_stale(rows, edges, c.supersession_weight)
    if c.activation_weight:
        rows = fusion.rerank(rows, fusion.activation_boost(F.col("importance"), F.col("maturity") if "maturity" in rows.columns else F.lit("draft"), F.col("created_at"), c.now, c.activation_weight, c.half_life_days))
    rows = without_inference(rows)
    if facts_found is not None:
        rows = fusion.source_floor(rows, facts_found, c.limit)
    rows = fusion.narrative_reserve(rows, c.limit)
    return rows.where((F.col("namespace") == c.namespace) & is_live(c.now))


def hybrid_search(memories: DataFrame, meta: DataFrame, edges: DataFrame, queries: DataFrame, c: Config, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, chunks: DataFrame | None = None, index=search.index, nearest=None) -> DataFrame:
    """(query_id, route, memory_id, rank0, score) of the best memories for each question (query_id, query).

    Edges, question features and the fused lists are each used several times, so they are written once; the lists have at
    most the pool of each signal per question.
    """
    edges = where_given(edges, project=c.project).select("edge_id", "memory_id", "source", "relation", "target", "source_norm", "relation_norm", "target_norm", "observed_at", "confidence", "superseded_by")
    asked, edges = cut_together(questions=features(queries), edges=edges)
    lists = signals(memories, meta, edges, asked, c.pool, vectors, query_vectors, chunks, c.now, c.namespace, index, nearest, c.project)
    if c.early_exit:
        done = resolved(lists["fts"], asked, memories)
        lists = {k: v if k in ("fts", "graph") else v.join(done, "query_id", "left_anti") for k, v in lists.items()}
    found = refine(cut(fuse(lists, asked), "fused"), memories, meta, edges, c, search.source_facts(lists["fts"], asked, memories, meta))
    if c.least_share > 0:
        texts = found.join(asked.select("query_id", "query"), "query_id").join(memories.select("memory_id", "summary"), "memory_id")
        found = texts.where(search.covered_share(F.col("query"), F.col("summary")) >= c.least_share).drop("query", "summary")
    return found.join(asked.select("query_id", "route"), "query_id").select("query_id", "route", "memory_id", "rank0", F.round("score", 9).alias("score"))


def resolved(fts: DataFrame, asked: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id) of single-hop questions whose best lexical hit holds all their terms."""
    best = fts.where("rank0 = 0").select("query_id", "memory_id").join(asked.where("route = 'single_hop'").select("query_id", "query"), "query_id")
    best = best.join(memories.select("memory_id", "summary"), "memory_id")
    whole = (F.size(event_terms(F.col("query"))) > 0) & (search.covered_share(F.col("query"), F.col("summary")) >= 1.0)
    return best.where(whole).select("query_id").distinct()


def reranked_search(search_with, queries: DataFrame, memories: DataFrame, limit: int, pool: int = 50, score=search.overlap_of) -> DataFrame:
    """(query_id, memory_id, rank0): the narrow result, then what a wide one has besides, fused with a scorer's order and cut to the limit.

    search_with(limit) gives (query_id, memory_id, rank0, ...).
    """
    both = cut(fusion.reanchor(search_with(limit), search_with(max(2 * limit, pool))), "pool")
    ranked = lexical_rerank(both.withColumn("score", -F.col("rank0").cast("double")), queries, memories, score)
    return ranked.where(F.col("rank0") < limit).select("query_id", "memory_id", "rank0")


def pin_profile(ranked: DataFrame, profile: DataFrame, limit: int) -> DataFrame:
    """(memory_id, kind, rank0): the profile (memory_id, kind; one row or none) first, then what is ranked (memory_id, kind, score)."""
    rest = ranked.join(profile.select("memory_id"), "memory_id", "left_anti").select("memory_id", "kind", F.lit(1).alias("_l"), "score")
    both = profile.select("memory_id", "kind", F.lit(0).alias("_l"), F.lit(0.0).alias("score")).unionByName(rest)
    return search.top(both.withColumn("_all", F.lit(0)), limit, "_l", F.desc("score"), "memory_id", by="_all").drop("_l", "_all", "score")


def lexical_rerank(found: DataFrame, queries: DataFrame, memories: DataFrame, score=search.overlap_of) -> DataFrame:
    """Found memories fused with their order by a scorer (question, text): without a model, the share of terms they have."""
    rows = found.join(queries.select("query_id", "query"), "query_id").join(search.of(memories, found).select("memory_id", "summary"), "memory_id")
    by = search.top(rows.withColumn("_s", score(F.col("query"), F.col("summary"))).drop("rank0").withColumn("_was", F.col("score")), 1 << 30, F.desc("_s"), F.desc("_was"), "memory_id")
    both = found.select("query_id", F.lit(0).alias("list_no"), F.lit(1).alias("weight"), "memory_id", "rank0").unionByName(by.select("query_id", F.lit(1).alias("list_no"), F.lit(1).alias("weight"), "memory_id", "rank0"))
    return fusion.rrf(both)


def multi_hop(search_once, queries: DataFrame, follow_up, hops: int = 2, last=None) -> DataFrame:
    """Searches, asks a follow-up question of what was found, and adds what that finds, hops times.

    search_once(queries) gives (query_id, memory_id, rank0); follow_up(queries, found) gives the next (query_id, query), none
    where nothing is left to ask; a question asked again adds nothing. last(found) is a final rerank.
    """
    found = cut(search_once(queries).select("query_id", "memory_id", "rank0"), "hop")
    said = queries.select("query_id", F.lower(F.trim("query")).alias("said"))
    for _ in range(hops):
        asked = follow_up(queries, found).select("query_id", "query").where("query IS NOT NULL")
        asked = cut(asked.join(said, (asked["query_id"] == said["query_id"]) & (F.lower(F.trim("query")) == said["said"]), "left_anti"), "follow-up")
        said = said.unionByName(asked.select("query_id", F.lower(F.trim("query")).alias("said")))
        found = cut(fusion.reanchor(found, search_once(asked).select("query_id", "memory_id", "rank0")), "hop")
    return last(found) if last else found


def injection_rank(memories: DataFrame, meta: DataFrame, relevance: DataFrame, adjustments: DataFrame, now: int, limit: int, half_life_days: float = 14.0, boosts: dict[str, float] | None = None) -> DataFrame:
    """The memories to show at a session's start, by relevance (memory_id, relevance), recency, importance, kind and feedback."""
    rows = with_meta(memories.select("memory_id", "created_at"), meta).where(is_live(now)).join(relevance, "memory_id", "left").join(adjustments, "memory_id", "left")
    age = F.greatest(F.lit(now) - F.col("created_at"), F.lit(0)) / 86400.0
    kind: Column = F.lit(1.0)
    for k, v in (boosts or {"fact": 1.1, "error_solution": 1.2, "preference": 1.15}).items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    z = lambda c: F.coalesce(c, F.lit(0))
    score = (0.5 * z("relevance") + 0.3 * half_life(age, half_life_days) + 0.2 * F.col("importance")) * kind * relational.reinforcement(z("positive"), z("negative"), z("n_shown"))
    return rows.select("memory_id", "kind", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "memory_id").limit(limit)


def context(found: DataFrame, memories: DataFrame) -> DataFrame:
    """Found memories (query_id, memory_id, rank0) without repeats of a summary, in U shape: the best at both ends."""
    same = F.lower(F.trim(F.regexp_replace("summary", r"\s+", " ")))
    found = cut(found.select("query_id", "memory_id", "rank0"), "found")
    rows = cut(found.join(search.of(memories, found).select("memory_id", "summary"), "memory_id").withColumn("_same", same).drop("summary"), "texts")
    first = rows.groupBy("query_id", "_same").agg(F.min("rank0").alias("rank0"))
    kept = rows.join(first, ["query_id", "_same", "rank0"], "left_semi").drop("_same").withColumnRenamed("rank0", "_r")
    return fusion.u_shape(search.top(kept, 1 << 30, "_r").drop("_r"))


def evidence(placed: DataFrame, memories: DataFrame, meta: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """What a context tells of its memories (query_id, memory_id, place), as rows: query_id, place, memory_id, part, n, id, text.

    part memory: the memory, n 0, with kind, event_time and source_ref. part chunk: its chunks from 1, in order. part edge: its
    active edges from 1, the surest first, then the newest. Rows, since a memory may have any number of edges.
    """
    ids = placed.select("memory_id").distinct()
    own = ids.join(memories.select("memory_id", "summary"), "memory_id").join(meta.select("memory_id", "kind", "event_time", "source_ref"), "memory_id", "left")
    none = F.lit(None).cast("string")
    about = [F.coalesce("kind", F.lit("session")).alias("kind"), "event_time", "source_ref"]
    own = own.select("memory_id", F.lit("memory").alias("part"), F.lit(0).cast("long").alias("n"), F.col("memory_id").cast("string").alias("id"), F.col("summary").alias("text"), *about)
    place = lambda *order: F.row_number().over(Window.partitionBy("memory_id").orderBy(*order)).cast("long").alias("n")
    about = [none.alias(c) for c in ("kind", "event_time", "source_ref")]
    c = chunks.join(ids, "memory_id", "left_semi").select("memory_id", F.lit("chunk").alias("part"), place("ordinal", "chunk_id"), F.col("chunk_id").alias("id"), F.col("title").alias("text"), *about)
    said = F.concat_ws(" ", "source", F.replace("relation", F.lit("_"), F.lit(" ")), "target")
    e = edges.where("superseded_by IS NULL").join(ids, "memory_id", "left_semi")
    e = e.select("memory_id", F.lit("edge").alias("part"), place(F.desc("confidence"), F.desc("observed_at"), F.desc("edge_id")), F.col("edge_id").cast("string").alias("id"), said.alias("text"), *about)
    return placed.select("query_id", "place", "memory_id").join(own.unionByName(c).unionByName(e), "memory_id")
