"""The whole search against a plain version of it, and its passes on small examples."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loreweave.functions import stem
from loreweave.functions.text import SOURCE_STOPWORDS
from loreweave.operators import compress, fusion, graph, search, visibility
from loreweave.plans import catalog_retrieval, catalog_text, registry, retrieve  # noqa: F401
from loreweave.sources.views import NOW, Tables

SF = "/root/testdata/sf0.001"


def plain_bm25(memories, queries):
    """(query_id, memory_id): score, from counts of stems in plain Python."""
    docs = {i: Counter(map(stem.stem, stem.tokens(" ".join(x for x in parts if x is not None)))) for i, *parts in memories}
    size = {i: sum(c.values()) for i, c in docs.items()}
    mean, n = sum(size.values()) / len(size), len(docs)
    df = Counter(w for c in docs.values() for w in c)
    out = {}
    for q, text in queries:
        words = {stem.stem(w) for w in stem.asked_tokens(text)}
        for i, c in docs.items():
            if words & c.keys():
                out[q, i] = sum(max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in sorted(words & c.keys()))
    return out


def ranked(rows):
    """{query: [memory, ...]} of (query_id, memory_id, rank0)."""
    out = defaultdict(dict)
    for r in rows.select("query_id", "memory_id", "rank0").collect():
        out[r.query_id][r.rank0] = r.memory_id
    assert all(sorted(x) == list(range(len(x))) for x in out.values())
    return {q: [x[i] for i in range(len(x))] for q, x in out.items()}


def test_lexical_list_like_brute_force(spark):
    t = Tables(spark, SF)
    m = [tuple(r) for r in t("memories").select("memory_id", "project", "session_id", "summary", "tags").collect()]
    scores = plain_bm25(m, [tuple(r) for r in t("queries").select("query_id", "query").collect()])
    seen = {r.memory_id: r.created_at for r in catalog_retrieval.live(t).collect()}
    want = defaultdict(list)
    for (q, i), s in scores.items():
        if i in seen:
            want[q].append((-round(s, 9), -seen[i], -i))
    got = ranked(search.search_project(catalog_retrieval.live(t), t("memories"), t("queries"), 20))
    assert got == {q: [-i for _, _, i in sorted(x)[:20]] for q, x in want.items()}


def test_whole_search_like_brute_force(spark):
    """From the signals' lists on, every pass of the registered search is done again in plain Python."""
    t = Tables(spark, SF)
    memories, meta, edges = t("memories"), t("memory_meta"), graph.reconcile(t("memory_edges"))
    c = retrieve.Config(now=NOW, tier_weight=0.002, trust_weight=0.004, supersession_weight=0.01, activation_weight=0.002)
    asked = retrieve.features(t("queries"))
    qv = t("queries").select("query_id", F.pmod("query_id", F.lit(500)).alias("memory_id")).join(t("memory_embeddings").select("memory_id", "embedding"), "memory_id").select("query_id", "embedding")
    lists = retrieve.signals(memories, meta, edges, asked, c.pool, t("memory_embeddings"), qv, catalog_retrieval.chunks(t), NOW)
    found = {k: ranked(v) for k, v in lists.items()}
    facts = {r.memory_id: r.asDict() for r in visibility.with_meta(memories, meta).collect()}
    state = defaultdict(list)
    for e in edges.collect():
        state[e.memory_id].append(((e.source_norm, e.relation_norm), e.superseded_by is None))

    def rerank(order, boost, at=None):
        at = at or order
        return sorted(order, key=lambda i: (-round(1 / (60 + at.index(i)) + boost(i), 12), at.index(i)))

    def age(at, days):
        return 0.5 ** (max(NOW - at, 0) / 86400 / days)

    queries = {r.query_id: r for r in asked.collect()}
    floors = defaultdict(list)
    for r in search.source_facts(lists["fts"], asked, memories, meta).collect():
        if r.n_shared >= 2 or (r.n_shared == 1 and r.n_terms == 1):
            floors[r.query_id].append((-r.n_shared, r.rank0, r.memory_id))
    want, floored = {}, 0
    for q, row in queries.items():
        score, first = defaultdict(float), {}
        for name in sorted(found, key=fusion.SIGNALS.index):
            weight = fusion.WEIGHTS[row.route][fusion.SIGNALS.index(name)]
            for at, i in enumerate(found[name].get(q, []) if weight else []):
                score[i] += weight / (60 + at)
                first.setdefault(i, (sorted(found, key=fusion.SIGNALS.index).index(name), at))
        fused = sorted(score, key=lambda i: (-round(score[i], 12), first[i], i))  # also such as edges and vectors alone know
        order = [i for i in fused if i in facts]
        trust = lambda i: 0.004 * facts[i]["trust_ref_count"] / (facts[i]["trust_ref_count"] + 3) * age(facts[i]["trust_last_validated_at"], 30) if facts[i]["trust_ref_count"] and facts[i]["trust_last_validated_at"] else 0
        order = rerank(order, trust, fused)
        order = rerank(order, lambda i: 0.002 * fusion.TIERS.get(facts[i]["trust_tier"], 0))
        open_keys = {key for i in order for key, live in state[i] if live}
        stale = {i for i in order if state[i] and not any(live for _, live in state[i]) and any(key in open_keys for key, _ in state[i])}
        order = rerank(order, lambda i: -0.01 if i in stale else 0)
        order = rerank(order, lambda i: 0.002 * min(max(facts[i]["importance"], 0), 1) * fusion.MATURITY.get(facts[i]["maturity"], 1) * age(facts[i]["created_at"], 30))
        order = [i for i in order if facts[i]["kind"] != "inference"]
        if len(order) > 10:
            up = [i for _, _, i in sorted(floors[q])[:2] if i in order]
            floored += bool(up) and order[: len(up)] != up
            order = up + [i for i in order if i not in up]
            sure = [i for i in order if facts[i]["kind"] != "fact"][:4]
            chosen = set((sure + [i for i in order if i not in sure])[:10])
            order = [i for i in order if i in chosen]
        live = lambda f: f["namespace"] == "local" and f["tombstoned_at"] is None and (f["expires_at"] is None or f["expires_at"] > NOW)
        if kept := [i for i in order if live(facts[i])]:
            want[q] = kept
    got = defaultdict(list)
    for r in sorted(catalog_retrieval.found(t).collect(), key=lambda r: (r.query_id, r.rank0)):
        got[r.query_id].append(r.memory_id)
    assert dict(got) == want and floored


def test_reranking_and_context_like_brute_force(spark):
    """What the registered reranking and context make of the search's lists is done again in plain Python."""
    t = Tables(spark, SF)
    narrow, wide = ranked_in_order(catalog_retrieval.found(t, 10)), ranked_in_order(catalog_retrieval.found(t, 50))
    texts = {r.memory_id: r.summary for r in t("memories").collect()}
    pairs = spark.createDataFrame([(q, i) for q, ids in wide.items() for i in {*ids, *narrow.get(q, [])}], "query_id long, memory_id long")
    rows = pairs.join(t("queries"), "query_id").join(t("memories").select("memory_id", "summary"), "memory_id")
    share = {(r.query_id, r.memory_id): r.s for r in rows.select("query_id", "memory_id", search.overlap_of(F.col("query"), F.col("summary")).alias("s")).collect()}
    want = {}
    for q in wide:
        base = narrow.get(q, []) + [i for i in wide[q] if i not in narrow.get(q, [])]
        by = sorted(base, key=lambda i: (-share[q, i], base.index(i), i))
        want[q] = sorted(base, key=lambda i: (-round(1 / (60 + base.index(i)) + 1 / (60 + by.index(i)), 12), base.index(i)))[:10]
    assert ranked_in_order(registry.QUERIES["reranked_search"](spark, SF)) == want

    places = {}
    for q, ids in narrow.items():
        seen, kept = set(), []
        for i in ids:
            key = " ".join(re.split(r"[ \t\n\x0b\f\r]+", texts[i])).strip(" ").lower()
            if key not in seen:
                seen.add(key)
                kept.append(i)
        order = kept[::2] + kept[1::2][::-1]
        places |= {(q, i): at for at, i in enumerate(order)}
    assert {(r.query_id, r.memory_id): r.place for r in registry.QUERIES["context_assembly"](spark, SF).collect()} == places


def test_best_spans_like_brute_force(spark):
    o = Tables(spark, SF)("observations")
    sections = defaultdict(list)
    for r in compress.transcript_sections(o).collect():
        sections[r.session_id].append(r)
    terms = lambda x: {w.lower() for w in re.findall(r"[^\W_]+", x) if len(w) >= 4} - set(SOURCE_STOPWORDS)
    want = {}
    for rows in sections.values():
        first = min(rows, key=lambda r: r.ordinal)
        fact = first.input if first.input is not None else first.output
        if fact is None:
            continue
        best = []
        for r in rows:
            exact = len(fact.strip(" ").encode()) >= 8 and fact.strip(" ").lower() in r.text.lower()
            n = len(terms(fact) & terms(r.text))
            if exact or n >= 2:
                best.append((exact, n, -r.start_byte, r.end_byte))
        if best:
            b = max(best)
            want[first.observation_id] = (-b[2], b[3])
    assert {r.fact_id: (r.start_byte, r.end_byte) for r in registry.QUERIES["best_spans"](spark, SF).collect()} == want and want


def ranked_in_order(rows):
    """{query: [memory, ...]} in the order of rank0, which may have gaps."""
    out = defaultdict(list)
    for r in sorted(rows.select("query_id", "memory_id", "rank0").collect(), key=lambda r: (r.query_id, r.rank0)):
        out[r.query_id].append(r.memory_id)
    return dict(out)


@pytest.fixture(scope="module")
def small(spark):
    m = spark.createDataFrame(
        [(1, "p", "s", "Caroline booked the vineyard trip", "fact", 10), (2, "p", "s", "the vineyard is closed", None, 20), (3, "p", "s", "Caroline moved (as of 2023)", "derived", 30), (4, "p", "s", "trip notes", "Source: x", 40)],
        "memory_id long, project string, session_id string, summary string, tags string, created_at long",
    )
    meta = spark.createDataFrame([(1, "fact"), (2, "session"), (3, "fact"), (4, "session")], "memory_id long, kind string")
    return m, meta


def test_source_facts(spark, small):
    q = spark.createDataFrame([(1, "Where did Caroline book the vineyard trip?"), (2, "trips"), (3, "the")], "query_id long, query string")
    found = spark.createDataFrame([(i, j, j - 1) for i in (1, 2, 3) for j in (1, 2, 3, 4)], "query_id long, memory_id long, rank0 long")
    got = sorted(tuple(r) for r in search.source_facts(found, q, *small).collect())
    assert got == [(1, 1, 0, 4, 4), (1, 4, 3, 1, 4), (2, 1, 0, 1, 1), (2, 4, 3, 1, 1)]


def test_early_exit_and_abstention(spark, small):
    q = spark.createDataFrame([(1, "vineyard Caroline trip", "single_hop"), (2, "vineyard Caroline zebra", "single_hop"), (3, "vineyard", "temporal")], "query_id long, query string, route string")
    fts = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 0), (1, 2, 1)], "query_id long, memory_id long, rank0 long")
    assert [r.query_id for r in retrieve.resolved(fts, q, small[0]).collect()] == [1]
    share = {r[0]: r[1] for r in q.select("query_id", search.covered_share(F.col("query"), F.lit("Caroline booked the vineyard trip"))).collect()}
    assert share[1] == 1.0 and round(share[2], 3) == 0.667
    assert spark.range(1).select(search.covered_share(F.lit("the"), F.lit("x"))).first()[0] == 1.0


def test_entities(spark, small):
    tokens = search.entity_tokens(small[0])
    asked = spark.createDataFrame([(1, " Caroline "), (2, "is"), (3, "trip")], "query_id long, entity string")
    assert sorted(tuple(r) for r in search.by_entity(tokens, small[0], asked, 1).select("query_id", "memory_id", "rank0").collect()) == [(1, 3, 0), (3, 4, 0)]


def test_wide_pool_can_rise(spark, small):
    q = spark.createDataFrame([(1, "vineyard trip")], "query_id long, query string")
    order = [2, 4, 3, 1]
    search_with = lambda limit: spark.createDataFrame([(1, i, n) for n, i in enumerate(order[:limit])], "query_id long, memory_id long, rank0 long")
    got = ranked(retrieve.reranked_search(search_with, q, small[0], 2, pool=4))
    assert got[1][0] == 1 or 1 in got[1]
    assert len(got[1]) == 2


def test_profile_comes_first(spark):
    rows = spark.createDataFrame([(1, "fact", 0.9), (2, "profile", 0.1), (3, "fact", 0.5)], "memory_id long, kind string, score double")
    first = lambda p, k: [r.memory_id for r in retrieve.pin_profile(rows, p, k).orderBy("rank0").collect()]
    assert first(rows.where("memory_id = 2").select("memory_id", "kind"), 2) == [2, 1]
    assert first(rows.where("memory_id = 9").select("memory_id", "kind"), 5) == [1, 3, 2]


def test_hops_end_where_a_question_comes_again(spark):
    q = spark.createDataFrame([(1, "a"), (2, "x")], "query_id long, query string")
    asked = []

    def once(d):
        asked.append(sorted(r.query for r in d.collect()))
        return d.select("query_id", F.when(F.col("query") == "a", 1).when(F.col("query") == "b", 2).otherwise(3).cast("long").alias("memory_id"), F.lit(0).cast("long").alias("rank0"))

    follow = lambda d, _: d.withColumn("query", F.when(F.col("query") == "a", " B ").otherwise("X"))
    got = ranked(retrieve.multi_hop(once, q, lambda d, f: follow(d, f).withColumn("query", F.lower(F.trim("query"))), 2, lambda rows: rows))
    assert got == {1: [1, 2], 2: [3]} and asked == [["a", "x"], ["b"], []]


def test_reconciling_a_hub_and_nulls(spark):
    """Half of all edges of one entity, equal edges, ties in time and null projects: as a loop over the edges does it."""
    import random

    from loreweave.operators import graph

    rng = random.Random(11)
    rows = []
    for i in range(1, 401):
        project = rng.choice(["p", "q", None])
        source = "Hub" if i % 2 else f"E{rng.randint(0, 9)}"
        rows.append((i, project, source, rng.choice(["status", "role", "likes"]), f"T{rng.randint(0, 4)}", rng.choice([None, "2024-01-01", "2024-02-01"]), rng.choice([None, None, None, "2025-01-01"]), 1000 + rng.randint(0, 60)))
    e = spark.createDataFrame(rows, "edge_id long, project string, source string, relation string, target string, valid_from string, valid_until string, observed_at long")
    newest = lambda r: (r[7], r[0])
    groups, states, want = {}, {}, {}
    for r in rows:
        groups.setdefault((r[1], r[2].lower(), r[3], r[4].lower(), r[5] or ""), []).append(r)
    alive = []
    for g in groups.values():
        first = max(g, key=newest)
        alive.append(first)
        want |= {r[0]: (first[0], "duplicate", r[6]) for r in g if r is not first}
    for r in alive:
        if r[6] is None and r[3] in ("status", "role"):
            states.setdefault((r[1], r[2].lower(), r[3]), []).append(r)
    for g in states.values():
        won = max(g, key=newest)
        want |= {r[0]: (won[0], "current_state", won[5] or str(won[7])) for r in g if r[4] != won[4]}
    for r in rows:
        want.setdefault(r[0], (None, None, r[6]))
    assert {r.edge_id: (r.superseded_by, r.superseded_reason, r.valid_until) for r in graph.reconcile(e).collect()} == want
