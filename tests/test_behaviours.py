"""What a memory must do, case by case: hops, dates, words, updates, silence, governance, chunks and levers, on small made stores."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loreweave.operators import fusion, graph, relational, search, visibility
from loreweave.plans import retrieve
from loreweave.plans.engine import Engine
from loreweave.functions.text import route

NOW = 1_780_000_000
MEMORIES = "memory_id long, project string, session_id string, summary string, tags string, created_at long"
META = "memory_id long, importance double, scope string, kind string, event_time string, namespace string, trust_tier string, expires_at long, tombstoned_at long, trust_last_validated_at long, trust_ref_count long, maturity string, legal_hold boolean, classification string"
EDGES = "edge_id long, project string, memory_id long, source string, relation string, target string, valid_from string, valid_until string, observed_at long, confidence double, created_at long"


class World:
    def __init__(self, spark):
        self.spark, self.rows, self.meta, self.edges, self.chunks, self.tables = spark, [], [], [], [], None

    def tell(self, project, text, **meta):
        n = len(self.rows) + 1
        self.rows.append((n, project, f"s{n}", text, None, NOW - 10_000 + n))
        known = {"importance": 0.5, "scope": "project", "kind": "session", "namespace": "local", "trust_tier": "medium", "trust_ref_count": 0, "maturity": "draft", "legal_hold": False, "classification": "internal"} | meta
        self.meta.append((n, *(known.get(f.strip().split()[0]) for f in META.split(",")[1:])))
        return n

    def link(self, memory, source, relation, target, since=None, confidence=0.9):
        n = len(self.edges) + 1
        self.edges.append((n, self.rows[memory - 1][1], memory, source, relation, target, since, None, NOW - 5000 + n, confidence, NOW - 5000 + n))

    def chunk(self, memory, title, text):
        self.chunks.append((memory, title, text, NOW))

    def ask(self, project, *questions, limit=3, **config):
        """The ids that each question finds, in order."""
        if self.tables is None:
            e = graph.insert_all(self.spark.createDataFrame(self.edges, EDGES))
            self.tables = [self.spark.createDataFrame(self.rows, MEMORIES).cache(), self.spark.createDataFrame(self.meta, META).cache(), e.cache(), self.spark.createDataFrame(self.chunks, "memory_id long, title string, summary string, created_at long").cache()]
        m, meta, e, c = self.tables
        q = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        found = defaultdict(list)
        for r in retrieve.hybrid_search(m, meta, e, q, retrieve.Config(now=NOW, limit=limit, project=project, **config), chunks=c).orderBy("rank0").collect():
            found[r.query_id].append(r.memory_id)
        return [found[i][:limit] for i in range(len(questions))]

    def about(self, project, entity, **kw):
        return {r.target for r in graph.for_entity(self.tables[2], entity, 10, project=project, **kw).collect()}


@pytest.fixture(scope="module")
def world(spark):
    w = World(spark)
    w.job = w.tell("hops", "Ines works at Nordwind as a welder")
    w.link(w.job, "Ines", "works_at", "Nordwind", confidence=0.95)
    w.seat = w.tell("hops", "Nordwind has its seat in Lisbon")
    w.link(w.seat, "Nordwind", "located_in", "Lisbon", confidence=0.95)
    w.needs = w.tell("needs", "The invoice worker depends on the ledger crate")
    w.link(w.needs, "invoice worker", "depends_on", "ledger crate")
    w.tell("needs", "The handbook pages were moved to another host")
    w.first, w.second = w.tell("shared", "Odile published the release notes"), w.tell("shared", "Odile led a review afterwards")
    w.oslo = w.tell("trips", "Odile visited Oslo for the winter course", event_time="2021-02-01")
    w.madrid = w.tell("trips", "Odile visited Madrid for the congress", event_time="2024-06-01")
    w.lead = w.tell("roles", "Tomas became the head of support")
    w.link(w.lead, "Tomas", "role", "head of support", since="2025-03-10")
    w.rule = w.tell("open", "The crew agreed on a soup friendly supper rule on Mondays")
    w.lamp = w.tell("open", "Tomas sketched a lighthouse with charcoal")
    w.key = w.tell("open", "Renew the sandbox access token every thirty days")
    for i in range(12):
        w.tell("pool", f"Regular maintenance entry {i} without anything of note")
    w.board = w.tell("pool", "The status board shows queue depth quantiles")
    w.story = w.tell("facts", "Long talk about many things, among them the orchard visit and further plans", kind="session")
    w.fact = w.tell("facts", "Odile reserved the orchard visit for 3 October 2024", kind="fact")
    w.was, w.now = w.tell("update", "Karim status candidate"), w.tell("update", "Karim status hired")
    w.link(w.was, "Karim", "status", "candidate", since="2025-01-01")
    w.link(w.now, "Karim", "status", "hired", since="2025-02-01", confidence=0.95)
    w.tell("drink", "Lena likes cocoa in the evening")
    w.fresh = w.tell("drink", "Lena now likes mint tea in the evening")
    w.tell("silence", "The relay station upgrade went well")
    w.gone = w.tell("silence", "The retired mailbox restore guide is outdated", tombstoned_at=NOW - 5)
    w.late = w.tell("silence", "The guest badge code runs out soon", expires_at=NOW - 3600)
    for project, extra in (("plain", {}), ("governed", {"trust_tier": "low", "namespace": "local"})):
        for text in ("The importer groups rows every four minutes", "Label counts fell after the host tag went", "The resend allowance for callbacks is two tries"):
            w.tell(project, text, kind="fact", **extra)
    w.theirs = w.tell("tenants", "Tenant beta allowance is nine terabytes", namespace="tenant-beta")
    w.parent = w.tell("chunks", "Monthly meeting papers were filed")
    w.chunk(w.parent, "budget", "Checked the yearly budget worksheet sums")
    return w


def test_hops(world):
    bridge, chain, direct = world.ask("hops", "How is Ines connected to Lisbon?", "Which city is related to Ines through her employer?", "Where does Ines work?")
    assert {world.job, world.seat} <= set(bridge) and world.seat in chain and direct[0] == world.job
    assert world.ask("needs", "Which worker depends on the ledger crate?", limit=1) == [[world.needs]]
    assert set(world.ask("shared", "What else did Odile do after the release?", limit=2)[0]) == {world.first, world.second}


def test_routes(spark):
    asked = [("How is Ines connected to Lisbon?", True), ("What happened after the upgrade?", True), ("Which worker depends on the ledger crate?", True), ("What is the capital of Peru?", False), ("supper rule", False)]
    rows = spark.createDataFrame(asked, "q string, hard boolean").select("q", "hard", route(F.col("q")).alias("route")).collect()
    assert [r.route in ("multi_hop", "temporal") for r in rows] == [r.hard for r in rows]


def test_dates(world):
    year, when = world.ask("trips", "Where did Odile travel in 2021?", "When did Odile visit Madrid?", limit=2)
    assert year[0] == world.oslo and when[0] == world.madrid
    assert world.about("roles", "tomas", day="2025-03-10") == {"head of support"} and not world.about("roles", "tomas", day="2025-03-09")


def test_words(world):
    rule, part, phrase = world.ask("open", "supper rule", "lighthouse charcoal artwork", "sandbox access token renewal")
    assert rule[0] == world.rule and world.lamp in part and world.key in phrase
    assert world.ask("pool", "queue depth quantiles", limit=5)[0][0] == world.board
    assert set(world.ask("facts", "orchard visit reservation date", limit=2)[0]) == {world.story, world.fact}
    assert world.ask("chunks", "yearly budget worksheet")[0] == [world.parent]


def test_updates(world, spark):
    world.ask("update", "Karim status")
    assert world.about("update", "karim") == {"hired"} and world.about("update", "karim", history=True) == {"hired", "candidate"}
    assert world.about("update", "karim", day="2025-01-15", history=True) == {"candidate"}
    assert world.fresh in world.ask("drink", "What does Lena like in the evening?", limit=2)[0]
    weigh = lambda up, down, n: spark.range(1).select(relational.reinforcement(F.lit(up), F.lit(down), F.lit(n))).first()[0]
    assert weigh(0.0, 1.0, 0) < 1 < weigh(1.5, 0.0, 3)


def test_silence(world):
    nothing, gone, late = world.ask("silence", "qxzwy vrumph blattic", "retired mailbox guide", "guest badge code", limit=5)
    assert nothing == [] and world.gone not in gone and world.late not in late
    assert world.ask("nobody", "What is the upgrade cadence?") == [[]]


def test_governance_costs_no_rank(world):
    texts = lambda ids: [world.rows[i - 1][3] for i in ids]
    plain, governed = (texts(world.ask(p, "callbacks resend allowance")[0]) for p in ("plain", "governed"))
    assert plain and plain == governed
    assert world.theirs not in world.ask("tenants", "tenant beta allowance")[0]
    assert world.ask("tenants", "tenant beta allowance", namespace="tenant-beta")[0] == [world.theirs]


def test_ripeness_pays(spark):
    rows = spark.createDataFrame([("core",), ("stable",), ("draft",)], "m string")
    boosts = {r.m: r.b for r in rows.select("m", fusion.activation_boost(F.lit(0.6), F.col("m"), F.lit(NOW), NOW, 0.02, 30.0).alias("b")).collect()}
    assert boosts["core"] > boosts["stable"] > boosts["draft"]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("behaviours") / "store"))


def test_explicit_writes(engine):
    e = engine
    a = e.remember("p", "The nightly backup starts at two", kind="fact")
    chunk = e.skim(a).first()
    assert (chunk.chunk_id, chunk.kind, chunk.density) == (f"mem:{a}:overview", "fact", "high") and e.chunk(chunk.chunk_id).memory_id == a
    row = e.t("memory_meta").where(F.col("memory_id") == a).first()
    assert (row.source_type, row.trust_tier, row.writer_identity, row.classification) == ("user_input", "high", "remember", "internal")
    for bad in ({"source_type": "rumour"}, {"trust_tier": "total"}, {"classification": "secret"}, {"consent_state": "maybe", "classification": "pii"}):
        with pytest.raises(ValueError):
            e.remember("p", "never stored", **bad)
    b = e.remember("p", "Reach them by the front desk", classification="pii", consent_state="granted")
    e.set_meta(a, maturity=" CORE ", kind="Procedural", scope="everyone", importance=0.9, event_time="2024-01-02")
    assert [e.memory(a)[c] for c in ("maturity", "kind", "scope", "importance", "event_time")] == ["core", "procedural", "project", 0.9, "2024-01-02"]
    e.set_meta(a, maturity="ancient", kind="gossip")
    assert (e.memory(a).maturity, e.memory(a).kind) == ("draft", "session") and e.memory(b).importance == 0.7
    with pytest.raises(ValueError, match="namespace"):
        e.set_meta(a, namespace="other")


def test_observed_lines(engine):
    e = engine
    story = e.remember("p", "Summary of the planning talk")
    ids = e.observe("p", "- [2023-05-07] P1 decision: Odile joined the choir\n- [-] P2 preference: Karim likes espresso\nnot a line\n- [2022-06-01] P3 rumour: Tomas sketched a lighthouse\n- [2022-06-01] P9 event: never\n", story)
    rows = [e.memory(i) for i in ids]
    assert [(r.summary, r.tags, r.importance, r.event_time) for r in rows] == [("Odile joined the choir", "decision", 0.85, "2023-05-07"), ("Karim likes espresso", "preference", 0.7, None), ("Tomas sketched a lighthouse", "event", 0.55, "2022-06-01")]
    assert {r.kind for r in rows} == {"observation"} and {r.writer_identity for r in rows} == {"observe"}
    assert [r.ancestor_id for r in e.lineage(ids[0])["parents"].collect()] == [story]
    years = search.by_year(e.t("memories"), e.t("memory_meta"), e.spark.createDataFrame([(1, "2022")], "query_id long, year string"), 10)
    assert [r.memory_id for r in years.collect()] == [ids[2]]
    named = e.spark.createDataFrame([(1, "espresso")], "query_id long, entity string")
    assert [r.memory_id for r in search.by_entity(e.t("memory_entities"), e.t("memories"), named, 5).collect()] == [ids[1]]


def test_trails_and_chains(engine):
    e = engine
    doomed = e.remember("p", "A marker that goes away")
    e.forget(doomed, "no longer needed")
    ops = [r.op_type for r in e.ledger(doomed).collect()]
    assert ops == ["remember", "forget"] and visibility.live(e.t("memories"), e.t("memory_meta"), "local", e.clock()).where(F.col("memory_id") == doomed).count() == 0
    kept = e.remember("p", "A subject of lineage")
    e.inject(50)
    trail = e.lineage(kept)
    assert trail["memory"].first().writer_identity == "remember" and trail["ledger"].first().op_type == "remember" and trail["injections"].count() == 1
    assert e.compliance()["chains"].first().n_broken == 0
    e.t.patch("memory_ledger", F.col("memory_id") == kept, payload="tampered")
    broken = e.compliance()["chains"].first()
    assert broken.n_broken == 1 and broken.first_broken == e.ledger(kept).first().id
