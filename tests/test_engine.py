import time
from threading import Thread

import pytest

from loreweave.operators import fulltext
from loreweave.plans.engine import ConsentError, Engine
from loreweave.sources import shared
from loreweave.sources.store import Store, _make, _said


class Clock:
    now = 1_700_000_000

    def __call__(self):
        self.now += 1
        return self.now


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, str(tmp_path_factory.mktemp("store")), clock=Clock(), most_output=60)


def test_a_session_becomes_a_memory(engine):
    sid = engine.session_start("p")
    engine.record_event(sid, "p", "Bash", "cargo test", "error: broken")
    engine.record_event(sid, "p", "Edit", "a.rs")
    engine.record_event(sid, "p", "Bash", "cargo test", "ok " * 40 + "\nRELATION: Alice | works_at | Acme")
    mid = engine.session_end(sid)
    assert engine.compress(sid) is None and engine.status()["memories"] == 1
    chunks = engine.skim(mid).collect()
    assert [c.ordinal for c in chunks] == [0, 1, 2, 3] and chunks[0].chunk_id == f"mem:{mid}:overview"
    assert engine.original(chunks[0].chunk_id) is None and engine.original(chunks[1].chunk_id).startswith("## Bash\ninput: cargo test")
    assert engine.corrections().count() == 1
    assert engine.t("blobs").where("orig_len > 100").count() >= 1
    assert engine.session_end(engine.session_start("p")) is None


def test_states_searches_and_governance(engine, spark, tmp_path):
    a = engine.remember("p", "Alice moved to Berlin in May 2023", kind="fact", event_time="2023-05-08")
    b = engine.remember("p", "Alice prefers tea", kind="preference", scope="user")
    edge = lambda target, day: spark.createDataFrame([("Alice", "location", target, day)], "source string, relation string, target string, valid_from string")
    engine.add_edges("p", a, edge("Rome", "2022-01-01"))
    engine.add_edges("p", a, edge("Berlin", "2023-05-08"))
    assert [r.target for r in engine.memory_graph("Alice").where("relation_norm = 'location'").collect()] == ["Berlin"]
    found = [r.memory_id for r in engine.search("When did Alice move to Berlin?", 3).orderBy("rank0").collect()]
    assert found[0] == a
    assert engine.get_context("Alice tea").count() >= 1
    assert "prefers tea" in engine.profile()
    for _ in range(3):
        engine.inject(5)
    engine.feedback(a, "used", 5.0)
    assert {r.memory_id: r.maturity for r in engine.promote().collect()}[a] == "core"
    with pytest.raises(ConsentError):
        engine.remember("p", "a diagnosis", classification="phi")
    c = engine.remember("p", "keep this", legal_hold=True)
    assert engine.forget(c) == "blocked" and engine.forget(b) == "deleted" and engine.forget(b) == "gone" and engine.forget(10**9) == "unknown"
    assert b not in [r.memory_id for r in engine.list_memories(limit=50).collect()]
    report = engine.compliance()
    assert report["chains"].first().n_broken == 0 and report["forks"].count() == 0
    assert engine.lineage(a)["ledger"].count() == 1
    assert engine.snapshot("p", str(tmp_path / "s"))["memories"] >= 3
    n = engine.status()["memories"]
    assert engine.restore(str(tmp_path / "s")) >= 3 and engine.status()["memories"] > n


def test_leases_sync_and_sweeps(engine, spark):
    assert engine.lease("x", "a") and not engine.lease("x", "b")
    engine.release("x", "a")
    assert engine.lease("x", "b")
    assert [engine.publish("n1", "put", {"i": i}) for i in range(2)] == [1, 2]
    events = engine.export_events(1)
    assert events.count() == 1 and engine.import_events(events) == 0
    sid = engine.session_start("q")
    engine.record_event(sid, "q", "Read", None, "text")
    engine.clock.now += 10_000
    assert [r.session_id for r in engine.sweep(idle=600).collect()] == [sid] and engine.sweep(idle=600).count() == 0
    assert engine.wipe_project("q")["memories"] == 1


def test_vectors_deletion_and_point_reads(spark, tmp_path):
    from loreweave.functions.vectors import folding_embedder

    e = Engine(spark, str(tmp_path / "store"), clock=Clock(), embed=folding_embedder(16), model="fold-16")
    sid = e.session_start("p")
    e.record_event(sid, "p", "Bash", "cargo test", "broken")
    a = e.session_end(sid)
    b = e.remember("p", "zzzz yyyy", kind="fact")
    c = e.remember("p", "on hold", legal_hold=True)
    d = e.remember("q", "elsewhere", scope="user", kind="preference")
    assert {r.memory_id for r in e.t("embeddings").collect()} == {a, b, c, d} and e.embed_all() == 0 and e.embed_all(force=True) == 4
    assert e.search("zzzy yyyz", 3).orderBy("rank0").first().memory_id == b  # no word in common: by vectors alone
    assert e.session(sid).compressed and e.session("none") is None and e.observations(sid).count() == 1
    assert e.memory(b).summary == "zzzz yyyy" and e.memory(10**9) is None
    assert Engine(spark, str(tmp_path / "store"), clock=e.clock, namespace="other").memory(b) is None
    assert Engine(spark, str(tmp_path / "store"), clock=e.clock, namespace="other").memory(b, any_namespace=True).memory_id == b
    assert e.recent_chunks().count() == 5 and e.n_own_memories() == 1 and e.t("memory_entities").where(f"memory_id = {b}").count() == 2
    hashes = {r.memory_id: r.record_hash for r in e.t("memory_meta").collect()}
    assert len(set(hashes.values())) == 4 and all(len(x) == 64 for x in hashes.values())
    e.feedback(b, "used", 1.0)
    e.inject(5)
    assert e.feedback_of(b).count() == 1 and e.injections_of(b).count() == 1
    e.snapshot("p", str(tmp_path / "s"), "first")
    assert [r.label for r in e.snapshots().collect()] == ["first"] and e.snapshots("none").count() == 0 and e.proposals("p", "applied").count() == 0

    assert e.t("blobs").count() == 1
    assert e.forget(a) == "deleted" and e.t("blobs").count() == 0 and a not in {r.memory_id for r in e.t("embeddings").collect()} and e.memory(a) is None
    gone = e.wipe_project("p", "closed")
    assert gone["memories"] == 2 and gone["injection_events"] >= 1  # what is on hold stays
    assert e.memory(c) is not None and e.memory(d) is not None and e.memory(b) is None and e.feedback_of(b).count() == 0
    assert [(r.memory_id, r.op_type) for r in e.ledger().collect()] == [(a, "remember"), (b, "remember"), (c, "remember"), (d, "remember"), (a, "forget"), (b, "forget")]
    assert e.ledger(b).count() == 2 and e.compliance()["chains"].first().n_broken == 0


def test_locks_are_held_by_one(spark, tmp_path):
    """A living holder keeps its lock however long it works; a dead one's is broken; who lost it learns that."""
    store, order = Store(spark, str(tmp_path)), []

    def second():
        with store.lock("x", patience=0.6):
            order.append("second")

    with store.lock("x", patience=0.6), store.lock("x"):
        waiter = Thread(target=second)
        waiter.start()
        time.sleep(2.0)
        order.append("first")
    waiter.join(20)
    assert order == ["first", "second"]

    fs, at = shared._of(spark, f"{tmp_path}/_locks/x")
    path = f"{tmp_path}/_locks/x"
    assert _make(spark, path, "dead") and not _make(spark, path, "other") and _said(fs, at) == "dead"
    fs.setTimes(at, int((time.time() - 100) * 1000), -1)
    with store.lock("x", patience=50):
        assert _said(fs, at) not in ("dead", None)
    assert not fs.exists(at)
    with pytest.raises(RuntimeError, match="lost"), store.lock("x"):
        fs.delete(at, False)
        assert _make(spark, path, "other")
    assert _said(fs, at) == "other"


def test_writers_in_parallel_lose_nothing(spark, tmp_path):
    engines = [Engine(spark, str(tmp_path / "store"), clock=Clock()) for _ in range(4)]
    failed = []

    def work(i):
        try:
            engines[i].remember("p", f"note {i}")
            engines[i].record_event("s", "p", "Read", None, f"text {i}")
            engines[i].feedback(1, "used", 1.0)
            engines[i].publish("n", "put", {"i": i})
        except Exception as error:
            failed.append(error)

    threads = [Thread(target=work, args=(i,)) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join(120)
    e = engines[0]
    ids = lambda name, c: sorted(r[0] for r in e.t(name).select(c).collect())
    assert not failed
    assert ids("memories", "memory_id") == ids("memory_meta", "memory_id") == ids("observations", "observation_id") == ids("memory_feedback", "event_id") == ids("memory_ledger", "id") == ids("sync_events", "lamport") == [1, 2, 3, 4]
    assert e.t("memory_meta").where("memory_id = 1").first().trust_ref_count == 4
    assert e.compliance()["chains"].first().n_broken == 0 and e.compliance()["forks"].count() == 0
    assert e.latencies.stats()["remember"]["count"] == 1


def session(e, project, text):
    sid = e.session_start(project)
    e.record_event(sid, project, "Bash", "run", text)
    return e.session_end(sid)


def test_a_shared_transcript_outlives_the_first_project(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), clock=Clock())
    a, b = session(e, "p", "same words"), session(e, "q", "same words")
    assert e.t("blobs").first().refcount == 2
    chunk = f"mem:{b}:obs:2"
    hidden = e.skim(a).where("source_hash IS NOT NULL").first().chunk_id
    assert e.original(hidden) and e.chunk(hidden) and e.expand(memory_id=a)
    assert e.forget(a) == "deleted" and e.t("blobs").first().refcount == 1
    assert e.skim(a).count() == 0 and e.original(hidden) is None and e.chunk(hidden) is None and e.expand(memory_id=a) is None and {r.memory_id for r in e.recent_chunks().collect()} == {b}
    assert e.index_all() == 2
    e.wipe_project("p")
    assert e.t("blobs").first().refcount == 1 and "same words" in e.original(chunk) and "same words" in e.expand(memory_id=b) and e.expand(observation_id=1) == "same words"
    assert e.expand(digest=e.t("blobs").first().hash, most=5).startswith("## Ba")
    assert {r.memory_id for r in fulltext.lengths(spark, e.words).collect()} == {b}


def test_snapshots_keep_what_governs(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), clock=Clock())
    a = session(e, "p", "hello\nRELATION: Alice | works_at | Acme")
    b = e.remember("p", "held", legal_hold=True, namespace="tenant", classification="pii", consent_state="granted", parent_memory_id=a)
    e.snapshot("p", str(tmp_path / "s"))
    assert e.restore(str(tmp_path / "s")) == 2
    meta = {r.memory_id: r for r in e.t("memory_meta").collect()}
    assert set(meta) == {a, b, a + 2, b + 2}
    new, old = meta[b + 2], meta[b]
    assert (new.legal_hold, new.namespace, new.classification, new.consent_state, new.record_hash) == (True, "tenant", "pii", "granted", old.record_hash) and new.parent_memory_id == a + 2
    assert e.forget(b + 2) == "blocked"
    assert {r.chunk_id.replace(f"mem:{a + 2}:", f"mem:{a}:") for r in e.skim(a + 2).collect()} == {r.chunk_id for r in e.skim(a).collect()} and e.t("blobs").first().refcount == 2
    assert sorted((r.edge_id, r.memory_id) for r in e.t("memory_edges").collect()) == [(1, a), (2, a + 2)]
    assert e.t("memory_ledger").where("op_type = 'restore'").count() == 2 and e.compliance()["chains"].first().n_broken == 0


REPLY = """SUMMARY: Alice moved the service to Berlin
FACTS:
- Alice moved to Berlin
- The service listens on port 9
TAGS: move berlin
IMPORTANCE: 8
KIND: fact
WHEN: 2024-05-01
ENTITIES:
- Berlin
RELATIONS:
- Alice | lives_at | Berlin
PROCEDURES:
- run make deploy
"""


def test_a_model_tells_facts_and_the_profile_is_pinned(spark, tmp_path):
    asked = []

    def generate(prompt):
        asked.append(prompt)
        if len(asked) == 1:
            raise OSError("timeout")
        return REPLY if "Alice" in prompt else "no fields"

    e = Engine(spark, str(tmp_path / "store"), clock=Clock(), generate=generate)
    mid = session(e, "p", "Alice moved to Berlin\nmake deploy")
    assert len(asked) == 2 and "FACTS" in asked[0]
    assert e.memory(mid).summary == "Alice moved the service to Berlin" and e.memory(mid).event_time == "2024-05-01" and e.memory(mid).kind == "fact"
    chunks = {r.chunk_id: r for r in e.skim(mid).collect()}
    assert list(chunks) == [f"mem:{mid}:{x}" for x in ("overview", "fact:1", "fact:2", "procedure:1", "obs:1")] and chunks[f"mem:{mid}:fact:1"].source_hash
    assert [(r.source, r.target) for r in e.edges().collect()] == [("Alice", "Berlin")]
    assert e.t("memory_entities").where(f"memory_id = {mid} AND entity = 'berlin'").count() == 1
    other = session(e, "p", "nothing of note")
    assert "nothing of note" in e.memory(other).summary and e.memory(other).kind == "session"

    own = [e.remember("p", f"likes tea number {i}", scope="user", kind="preference") for i in range(5)]
    profile = e.live().where("kind = 'profile'").collect()
    assert len(profile) == 1 and profile[0].memory_id == own[-1] + 1 and e.profile() == profile[0].summary and "number 4" in e.profile()
    shown = e.inject(3).orderBy("rank0").collect()
    assert shown[0].memory_id == profile[0].memory_id and len(shown) == 3
    assert e.injections_of(shown[1].memory_id).first().rank_pos == 1
    e.remember("p", "likes coffee", scope="user", kind="preference")
    new = e.refresh_profile()
    assert [r.memory_id for r in e.live().where("kind = 'profile'").collect()] == [new] and "coffee" in e.profile()


def test_the_stored_index_answers_like_texts(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"), clock=Clock())
    ids = [e.remember("p", x) for x in ("red apples and pears", "green apples", "pears pears pears")]
    plain = [tuple(r) for r in e.search("apples or pears", 5).orderBy("rank0").collect()]
    assert e.index_all() == 3 and e.index_all() == 0
    assert [tuple(r) for r in e.search("apples or pears", 5).orderBy("rank0").collect()] == plain
    late = e.remember("p", "more apples than pears")  # not in the index yet
    found = [r.memory_id for r in e.search("apples pears", 5).orderBy("rank0").collect()]
    assert set(found) == {*ids, late}


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    """Only one machine may fall back to a folder of its own; tables that are done with can be deleted at once."""
    from types import SimpleNamespace

    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        shared.shared_folder(session)
    table = shared.cut(spark.range(5), "few")
    fs, at = shared._of(spark, table._written)
    assert table.count() == 5 and fs.exists(at)
    shared.discard(table)
    assert not fs.exists(at)


def test_vectors_in_cells_answer_like_all(spark, tmp_path):
    from loreweave.functions.vectors import folding_embedder

    e = Engine(spark, str(tmp_path / "store"), clock=Clock(), embed=folding_embedder(16), model="fold-16")
    for x in ("zzzz yyyy", "aaaa bbbb", "zzzy yyyz qq"):
        e.remember("p", x)
    plain = [tuple(r) for r in e.search("yyyy zzzz", 3).orderBy("rank0").collect()]
    e.index_vectors()
    assert [tuple(r) for r in e.search("yyyy zzzz", 3).orderBy("rank0").collect()] == plain
    late = e.remember("p", "zyzy yzyz")
    assert late in {r.memory_id for r in e.search("yzyz zyzy", 4).collect()}


def test_a_dream_comes_once_per_idle_period(spark, tmp_path):
    clock = Clock()
    e = Engine(spark, str(tmp_path / "store"), clock=clock)
    e.remember("p", "one note of a project")
    assert e.dream_idle(600) == {}
    clock.now += 1000
    assert e.dream_idle(600) == {"p": "ok"} and e.dream_idle(600) == {}
    assert e.t("sweep_events").where("action = 'dream' AND status = 'ok'").count() == 1 and e.index_all() == 0
    e.remember("p", "something new")
    e.remember("q", "another project")
    assert e.dream_idle(600) == {}
    clock.now += 1000
    e.reflect = lambda *a, **kw: 1 / 0
    assert e.dream_idle(600) == {"p": "failed", "q": "failed"}
    del e.reflect
    assert e.dream_idle(600, limit=1) == {"p": "ok"} and e.dream_idle(600) == {"q": "ok"} and e.dream_idle(600) == {}
