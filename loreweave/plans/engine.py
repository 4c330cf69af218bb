"""The operations of a memory service as functions over stored tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.hashing import RECORD_FIELDS, entry_hash, record_hash
from loreweave.functions.text import MEMORY_KINDS, normalize_graph_text, normalize_namespace, normalize_relation, truncate_bytes
from loreweave.operators import anchors, ann, blobs, compress, consolidate, fulltext, govern, graph, knn, relational, search, visibility
from loreweave.plans import retrieve
from loreweave.plans.schedule import Latencies, retried
from loreweave.sources.shared import cut
from loreweave.sources.store import Store

#: Bytes of a transcript that a language model is shown, and the user's memories after which the profile is made anew.
MOST_SHOWN, PROFILE_EVERY = 48_000, 5


class ConsentError(ValueError):
    """Health or personal data without consent."""


def timed(f):
    """An operation whose calls and microseconds are counted under its name."""

    @wraps(f)
    def run(self, *a, **kw):
        with self.latencies.timed(f.__name__):
            return f(self, *a, **kw)

    return run


def writes(f):
    """A timed operation that reads tables and then writes them: one at a time, of all writers of the store."""

    @wraps(f)
    def run(self, *a, **kw):
        with self.t.writing():
            return f(self, *a, **kw)

    return timed(run)


class Engine:
    """Sessions in, memories out. clock gives Unix seconds; embed is a column function from text to vector, if there is one.

    Vectors are kept under the name of their model, and searched among those of that model alone. Every operation that gives
    out numbers, extends a chain or replaces a table holds the store's one lock of writers, so several can share it. generate
    is a language model, from prompt to reply; without one, a session's memory is its transcript. Words are searched in a
    stored index, and in the texts of the memories that came since `index_all`.
    """

    def __init__(self, spark: SparkSession, root: str, clock=lambda: int(time.time()), namespace: str = "local", most_output: int = 16_384, config: dict | None = None, embed=None, model: str = "default", generate: Callable[[str], str] | None = None):
        self.embed, self.model, self.generate = embed, model, generate
        self.words, self.cells, self.latencies = f"{root.rstrip('/')}/_words", f"{root.rstrip('/')}/_cells-{model}", Latencies()
        self.spark, self.t, self.clock, self.namespace, self.most = spark, Store(spark, root), clock, namespace, most_output
        self.config = config or {}

    def _rows(self, name: str, *rows: dict) -> DataFrame:
        from loreweave.sources.store import SCHEMAS

        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    # Sessions

    @writes
    def session_start(self, project: str) -> str:
        sid = uuid.uuid4().hex
        self.t.append("sessions", self._rows("sessions", {"session_id": sid, "project": project, "started_at": self.clock(), "compressed": False}))
        return sid

    @writes
    def record_event(self, session_id: str, project: str, tool: str, given: str | None = None, output: str | None = None) -> int:
        """Keeps the whole output as a blob if it is cut."""
        n = self.t.next_id("observations", "observation_id")
        row = self._rows("observations", {"observation_id": n, "session_id": session_id, "project": project, "tool": tool, "input": given, "output": output, "created_at": self.clock()})
        if len((output or "").encode()) > self.most:
            self._store(row.select(F.col("output").alias("text")))
            row = row.withColumns({"output_blob": F.sha2("output", 256), "output": truncate_bytes(F.col("output"), self.most)})
        self.t.append("observations", row)
        return n

    def _store(self, texts: DataFrame) -> None:
        new = blobs.store(texts).withColumn("content_type", blobs.content_type(F.col("data")))
        both = self.t("blobs").unionByName(self.t.fit("blobs", new))
        self.t.replace("blobs", both.groupBy("hash").agg(F.first("content_type").alias("content_type"), F.first("orig_len").alias("orig_len"), F.first("data").alias("data"), F.sum("refcount").alias("refcount")))

    def session_end(self, session_id: str) -> int | None:
        """Closes an open session and compresses it; without observations there is nothing to keep."""
        mine = F.col("session_id") == session_id
        with self.t.writing():
            self.t.patch("sessions", mine & F.col("ended_at").isNull(), ended_at=self.clock())
        return self.compress(session_id) if self.t("observations").where(mine).limit(1).count() else None

    @timed
    def compress(self, session_id: str) -> int | None:
        """The session's memory, its transcript as a blob, and its chunks. Done once.

        A language model's reply gives the summary, facts, procedures, date, kind, entities and relations (compress.parse_reply);
        without one, or a summary in its reply, the memory is the transcript. It is called outside the lock.
        """
        mine = F.col("session_id") == session_id
        if self.t("sessions").where(mine & F.col("compressed")).limit(1).count():
            return None
        o = self.t("observations").where(mine)
        row = compress.local_compression(o).first()
        said = {"facts": [], "procedures": [], "relations": [], "entities": [], "when": None, "kind": "session"}
        told = {"summary": row.summary, "tags": row.tags, "importance": row.importance}
        if self.generate:
            text = compress.transcripts(o).select(truncate_bytes(F.col("transcript"), MOST_SHOWN).alias("x")).first().x
            reply = compress.parse_reply(retried(lambda: self.generate(compress.prompt(text))))
            if reply["summary"]:
                said |= {k: reply[k] for k in said} | {"kind": reply["kind"] if reply["kind"] in MEMORY_KINDS else "session"}
                told = {k: reply[k] or v for k, v in told.items()}
        with self.t.writing():
            if self.t("sessions").where(mine & F.col("compressed")).limit(1).count():
                return None  # by another writer, meanwhile
            mid = self._add(row.project, told["summary"], told["tags"], session_id, govern.COMPRESSED | {"importance": told["importance"] / 10, "kind": said["kind"], "event_time": said["when"]})
            self._store(compress.transcripts(o).select(F.col("transcript").alias("text")))
            head = self.spark.createDataFrame(
                [(mid, row.project, session_id, told["summary"], said["kind"], told["importance"], said["when"], said["facts"], said["procedures"])],
                "memory_id long, project string, session_id string, summary string, kind string, importance int, event_time string, facts array<string>, procedures array<string>",
            )
            self._replace_chunks(mid, compress.memory_chunks(head, o).withColumn("created_at", F.lit(self.clock())))
            if said["entities"]:
                self.t.upsert("memory_entities", self.spark.createDataFrame([(mid, x) for x in {x.lower() for x in said["entities"] if len(x) >= 3}], "memory_id long, entity string"), "memory_id", "entity")
            lines = self.spark.createDataFrame([(f"RELATION: {x}",) for x in said["relations"]], "t string")
            self._add_edges(row.project, mid, compress_relations(o).unionByName(graph.relation_markers(lines, "t")).distinct())
            self.t.patch("sessions", mine, compressed=True)
        return mid

    def _replace_chunks(self, memory_id: int, chunks: DataFrame) -> None:
        """A memory's chunks, in place of those it had."""
        old = self.t("memory_chunks")
        if old.where(F.col("memory_id") == memory_id).limit(1).count():
            self.t.delete("memory_chunks", self.spark.createDataFrame([(memory_id,)], "memory_id long"), "memory_id")
        self.t.append("memory_chunks", self.t.fit("memory_chunks", chunks))

    # Memories

    def _remember(self, project: str, summary: str, tags: str | None, session_id: str | None, **meta) -> int:
        with self.t.writing():
            mid = self._add(project, summary, tags, session_id, meta)
            kind, importance = meta.get("kind", "session"), int(meta.get("importance", 0.5) * 10)
            head = self.spark.createDataFrame([(mid, project, session_id, summary, kind, importance, meta.get("event_time"))], "memory_id long, project string, session_id string, summary string, kind string, importance int, event_time string")
            self.t.append("memory_chunks", self.t.fit("memory_chunks", compress.overview_chunks(head).withColumn("created_at", F.lit(self.clock()))))
            return mid

    def _add(self, project: str, summary: str, tags: str | None, session_id: str | None, meta: dict) -> int:
        mid, now = self.t.next_id("memories", "memory_id"), self.clock()
        meta = {"memory_id": mid, "importance": 0.5, "scope": "project", "kind": "session", "namespace": self.namespace, "source_type": "derived", "trust_tier": "medium", "classification": "internal", "legal_hold": False, "trust_ref_count": 0, "maturity": "draft"} | meta
        row = self._rows("memory_meta", govern.checked(meta)).withColumn("namespace", normalize_namespace(F.col("namespace")))
        if row.where(~visibility.consent_ok()).count():
            raise ConsentError(f"{meta['classification']} needs consent_state = 'granted'")
        memory = self._rows("memories", {"memory_id": mid, "project": project, "session_id": session_id, "summary": summary, "tags": tags, "created_at": now})
        self.t.append("memories", memory)
        whole = memory.join(row, "memory_id")
        record = record_hash(**{k: F.col(k) for k in RECORD_FIELDS if k in whole.columns})
        self.t.append("memory_meta", whole.select(*row.drop("record_hash").columns, record.alias("record_hash")))
        self.t.append("memory_entities", search.entity_tokens(memory))
        if self.embed:
            self.t.append("embeddings", self._embedded(memory))
        self._log("remember", mid, {"kind": meta["kind"]})
        return mid

    def _embedded(self, memories: DataFrame) -> DataFrame:
        rows = memories.select("memory_id", F.lit(self.model).alias("model"), self.embed(F.concat_ws(" ", "summary", "tags")).alias("embedding"))
        return rows.withColumn("dim", F.size("embedding"))

    @writes
    def embed_all(self, force: bool = False) -> int:
        """Vectors of this model for memories that lack one, or anew for all; returns how many."""
        if force:
            self.t.delete("embeddings", self.spark.createDataFrame([(self.model,)], "model string"), "model")
        have = self.t("embeddings").where(F.col("model") == self.model).select("memory_id")
        rows = self.t("memories").join(have, "memory_id", "left_anti")
        n = rows.count()
        if n:
            self.t.append("embeddings", self._embedded(rows))
        if force and ann.exists(self.spark, self.cells):
            self.index_vectors()
        return n

    @writes
    def index_vectors(self) -> None:
        """Builds the stored index of this model's vectors anew; until then, vectors that came since are searched one by one."""
        ann.build(self.t("embeddings").where(F.col("model") == self.model).select("memory_id", "embedding"), self.cells)

    def _nearest(self, vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """knn.nearest from the stored index, if there is one, and the vectors that it doesn't have."""
        if not ann.exists(self.spark, self.cells):
            return knn.nearest(vectors, asked, k, include_self=True)
        mark = ann.newest(self.spark, self.cells)
        new = vectors if mark is None else vectors.where(F.col("memory_id") > mark)
        both = ann.search(self.spark, self.cells, asked, k, include_self=True).drop("rank0", "certain").unionByName(knn.nearest(new, asked, k, include_self=True).drop("rank0"))
        return search.top(both, k, F.desc(F.round("similarity", 9)), "memory_id")

    @writes
    def index_all(self) -> int:
        """Adds the words of memories that came since the last call to the stored index, as a segment; returns how many."""
        mark = fulltext.indexed(self.spark, self.words)
        new = self.t("memories") if mark is None else self.t("memories").where(F.col("memory_id") > mark)
        if not new.limit(1).count():
            return 0
        return fulltext.add(search.memory_texts(new), self.words, fulltext.next_segment(self.spark, self.words))

    def _index(self, memories: DataFrame, asked: DataFrame) -> DataFrame:
        """search.index from the stored index and the texts of the memories that it doesn't have."""
        mark = fulltext.indexed(self.spark, self.words)
        if mark is None:
            return search.index(memories, asked)
        new = memories.where(F.col("memory_id") > mark)
        return fulltext.ready(self.spark, self.words, asked).unionByName(search.index(new, asked))

    @writes
    def remember(self, project: str, summary: str, tags: str | None = None, **meta) -> int:
        """A memory that was asked for. Every fifth of the user's own makes the profile anew."""
        mid = self._remember(project, summary, tags, None, **(govern.EXPLICIT | {"importance": 0.7} | meta))
        if meta.get("scope") == "user" and meta.get("kind") != "profile" and self.n_own_memories() % PROFILE_EVERY == 0:
            self.refresh_profile()
        return mid

    @writes
    def observe(self, project: str, reply: str, parent: int | None = None) -> list[int]:
        """Memories of a model's dated lines (compress.observer_lines), with the memory that they belong to as parent."""
        lines = compress.observer_lines(self.spark.createDataFrame([(reply,)], "t string"), "t").collect()  # one reply
        made = govern.DERIVED | {"writer_identity": "observe", "kind": "observation", "parent_memory_id": parent}
        return [self._remember(project, r.line, r.category, None, **made, importance=r.importance, event_time=r.day) for r in lines]

    @writes
    def set_meta(self, memory_id: int, **values) -> None:
        """Sets kind, scope, maturity, importance or event_time of a memory; unknown kinds, scopes and maturities become the usual ones."""
        if other := set(values) - {"kind", "scope", "maturity", "importance", "event_time"}:
            raise ValueError(f"not to be set: {', '.join(sorted(other))}")
        known = {"kind": (MEMORY_KINDS, "session"), "scope": (("user",), "project"), "maturity": (("stable", "core"), "draft")}
        clamped = {k: (v.strip().lower() if v.strip().lower() in known[k][0] else known[k][1]) if k in known else v for k, v in values.items()}
        self.t.patch("memory_meta", F.col("memory_id") == memory_id, **clamped)

    @writes
    def refresh_profile(self) -> int | None:
        """Stores the profile of the user's memories, in place of the one before; None if there are none."""
        text = consolidate.profile(self.live()).first().profile
        if not text:
            return None
        old = [r.memory_id for r in self.live().where("kind = 'profile'").select("memory_id").collect()]  # one, as a rule
        mid = self._add("profile", text, None, None, govern.DERIVED | {"kind": "profile", "scope": "user", "importance": 0.9})
        for x in old:
            self.forget(x, "replaced")
        return mid

    def _log(self, op: str, memory_id: int | None, payload: dict) -> None:
        """Appends an entry to the namespace's chain."""
        with self.t.writing():
            last = self._head()
            row = {"namespace": self.namespace, "id": last.id + 1 if last else 1, "memory_id": memory_id, "op_type": op, "payload": json.dumps(payload, sort_keys=True), "created_at": self.clock(), "prev_hash": last.entry_hash if last else None}
            cols = ("prev_hash", "namespace", "memory_id", "op_type", "actor", "payload", "created_at")
            self.t.append("memory_ledger", self._rows("memory_ledger", row).withColumn("entry_hash", entry_hash(*[F.col(c) for c in cols])))

    def _head(self) -> Row | None:
        return self.t("memory_ledger").where(F.col("namespace") == self.namespace).orderBy(F.desc("id")).first()

    def _log_all(self, op: str, memories: DataFrame, payload: dict) -> None:
        """Appends an entry for each of memories (memory_id), in order of id, in one write."""
        with self.t.writing():
            last = self._head()
            new = relational.numbered(memories.select("memory_id"), "id", last.id + 1 if last else 1, "memory_id")
            values = {"namespace": self.namespace, "op_type": op, "payload": json.dumps(payload, sort_keys=True)}
            new = new.withColumns({k: F.lit(v) for k, v in values.items()} | {"actor": F.lit(None).cast("string"), "created_at": F.lit(self.clock()).cast("long")})
            heads = self.spark.createDataFrame([(self.namespace, last.entry_hash)] if last else [], "namespace string, entry_hash string")
            self.t.append("memory_ledger", govern.build_chain(new, heads))

    @writes
    def forget(self, memory_id: int, reason: str = "asked") -> str:
        """blocked by a legal hold, gone already, or deleted: hidden, entered in the ledger, its transcript and vectors released."""
        mine = F.col("memory_id") == memory_id
        outcome = relational.governed_delete(self.t("memory_meta"), self.spark.createDataFrame([(memory_id,)], "memory_id long"), self.clock()).first()
        if outcome and outcome.outcome == "deleted":
            self.t.patch("memory_meta", mine, tombstoned_at=self.clock(), tombstone_reason=reason)
            self._log("forget", memory_id, {"reason": reason})
            self._release(self.spark.createDataFrame([(memory_id,)], "memory_id long"))
        return outcome.outcome if outcome else "unknown"

    def _release(self, gone: DataFrame) -> None:
        """The blobs and vectors of memories (memory_id) that were there till now: each transcript loses a reference per memory,
        and goes with the last. A memory that was forgotten before has released its own already."""
        used = self.t("memory_chunks").join(gone, "memory_id", "left_semi").where("source_hash IS NOT NULL").select("memory_id", "source_hash").distinct()
        less = cut(used.groupBy(F.col("source_hash").alias("hash")).agg(F.count("*").alias("less")), "released")
        if less.limit(1).count():
            left = self.t("blobs").join(less, "hash", "left").withColumn("refcount", F.greatest(F.col("refcount") - F.coalesce("less", F.lit(0)), F.lit(0)))
            self.t.replace("blobs", left.where("refcount > 0"))
        self.t.delete("embeddings", gone, "memory_id")

    @writes
    def wipe_project(self, project: str, reason: str = "project wiped") -> dict[str, int]:
        """Deletes a project's memories, but for those on hold, from every table; each that was there gets its entry in the ledger."""
        held = self.t("memory_meta").where("legal_hold").select("memory_id")
        gone = cut(self.t("memories").where(F.col("project") == project).join(held, "memory_id", "left_anti").select("memory_id"), "gone")
        hidden = self.t("memory_meta").where("tombstoned_at IS NOT NULL").select("memory_id")
        there = cut(gone.join(hidden, "memory_id", "left_anti"), "there")
        self._log_all("forget", there, {"reason": reason})
        self._release(there)
        mark = fulltext.indexed(self.spark, self.words)
        if mark is not None:
            fulltext.remove(gone.where(F.col("memory_id") <= mark), self.words, fulltext.next_segment(self.spark, self.words))
        out = {}
        for name in ("memories", "memory_meta", "embeddings", "memory_entities", "memory_edges", "memory_chunks", "memory_feedback", "injection_events"):
            out[name] = self.t(name).join(gone, "memory_id", "left_semi").count()
            self.t.delete(name, gone, "memory_id")
        return out

    # Point reads and lists

    def session(self, session_id: str) -> Row | None:
        return self.t("sessions").where(F.col("session_id") == session_id).first()

    def observations(self, session_id: str) -> DataFrame:
        return self.t("observations").where(F.col("session_id") == session_id).orderBy("created_at", "observation_id")

    def memory(self, memory_id: int, any_namespace: bool = False) -> Row | None:
        """A visible memory of the namespace, or of any."""
        rows = visibility.with_meta(self.t("memories"), self.t("memory_meta")).where(visibility.is_live(self.clock()))
        return rows.where((F.col("memory_id") == memory_id) & (F.lit(any_namespace) | (F.col("namespace") == self.namespace))).first()

    def feedback_of(self, memory_id: int) -> DataFrame:
        return self.t("memory_feedback").where(F.col("memory_id") == memory_id).orderBy("created_at", "event_id")

    def injections_of(self, memory_id: int) -> DataFrame:
        return self.t("injection_events").where(F.col("memory_id") == memory_id).orderBy("created_at", "event_id")

    def ledger(self, memory_id: int | None = None) -> DataFrame:
        """The namespace's chain, or a memory's entries in it."""
        return visibility.where_given(self.t("memory_ledger").where(F.col("namespace") == self.namespace), memory_id=memory_id).orderBy("id")

    def proposals(self, project: str | None = None, status: str | None = None) -> DataFrame:
        return visibility.where_given(self.t("reflection_proposals"), project=project, status=status).orderBy(F.desc("created_at"), F.desc("proposal_id"))

    def snapshots(self, snapshot_id: str | None = None) -> DataFrame:
        return visibility.where_given(self.t("brain_snapshots"), snapshot_id=snapshot_id).orderBy(F.desc("created_at"), "snapshot_id")

    def anchored(self, project: str) -> DataFrame:
        return self.t("code_anchors").where(F.col("project") == project).orderBy("path", "start_byte", "memory_id")

    def chunks(self) -> DataFrame:
        """The chunks of visible memories of the namespace."""
        return self.t("memory_chunks").join(self.live().select("memory_id"), "memory_id", "left_semi")

    def chunk(self, chunk_id: str) -> Row | None:
        return self.chunks().where(F.col("chunk_id") == chunk_id).first()

    @writes
    def anchor(self, project: str, files: DataFrame) -> int:
        """Anchors the project's visible memories to the symbols of source files (path, text) that they name; returns how many.
        An anchor of the same memory, path, kind and name is replaced."""
        found = cut(anchors.symbols(files), "symbols")
        mine = self.live().where(F.col("project") == project).select("memory_id", "summary")
        new = anchors.mentions(mine, found).join(found, ["path", "kind", "name"]).withColumn("project", F.lit(project))
        new = cut(self.t.fit("code_anchors", relational.keep_last(new, ["memory_id", "path", "kind", "name"], "start_byte")), "anchors")
        n = new.count()
        if n:
            self.t.upsert("code_anchors", new, "project", "memory_id", "path", "kind", "name")
        return n

    @writes
    def relink(self, project: str, files: DataFrame) -> DataFrame:
        """Moves the project's anchors to where their symbols are in the files now; those found nowhere stay. Returns what was found."""
        found = cut(anchors.symbols(files), "symbols")
        mine = self.t("code_anchors").where(F.col("project") == project)
        where = cut(anchors.relink(mine, found), "relinked")
        new = where.select("memory_id", "kind", F.col("name").alias("_name"), F.col("hash").alias("_hash"), F.col("now_name").alias("name"), F.col("now_hash").alias("hash"), "path", "start_byte", "end_byte")
        new = new.join(found.select("path", "start_byte", "shingles"), ["path", "start_byte"]).withColumn("project", F.lit(project))
        gone = where.select("memory_id", "name", "kind", "hash")
        moved = self.t("code_anchors").join(gone.withColumn("project", F.lit(project)), ["project", "memory_id", "name", "kind", "hash"], "left_anti").unionByName(self.t.fit("code_anchors", new))
        self.t.replace("code_anchors", cut(moved, "anchors"))
        return where

    def recent_chunks(self, limit: int = 20, project: str | None = None) -> DataFrame:
        return visibility.where_given(self.chunks(), project=project).orderBy(F.desc("created_at"), F.desc("memory_id"), "ordinal").limit(limit)

    def edges(self, project: str | None = None) -> DataFrame:
        """All edges in the order of an export."""
        return visibility.where_given(self.t("memory_edges"), project=project).orderBy("edge_id")

    def n_own_memories(self) -> int:
        """The user's visible memories, without the profile."""
        return self.live().where("scope = 'user' AND kind <> 'profile'").count()

    def live(self) -> DataFrame:
        return visibility.live(self.t("memories"), self.t("memory_meta"), self.namespace, self.clock())

    def list_memories(self, project: str | None = None, limit: int = 20) -> DataFrame:
        return visibility.recent(self.live(), limit, project)

    def list_projects(self) -> DataFrame:
        return relational.project_summary(self.t("memories"), self.t("sessions"))

    def list_sessions(self, limit: int = 20) -> DataFrame:
        return relational.session_history(self.t("sessions"), self.t("memories"), self.t("observations")).orderBy(F.desc("started_at")).limit(limit)

    def profile(self) -> str:
        """The stored profile; before there is one, what it would be."""
        row = self.live().where("kind = 'profile'").orderBy(F.desc("memory_id")).first()
        return row.summary if row else consolidate.profile(self.live()).first().profile

    # Graph

    @writes
    def add_edges(self, project: str, memory_id: int, edges: DataFrame) -> None:
        """edges: source, relation, target, and valid_from, valid_until, confidence if known. Old states end where new ones begin."""
        self._add_edges(project, memory_id, edges)

    def _add_edges(self, project: str, memory_id: int, edges: DataFrame) -> None:
        if not edges.limit(1).count():
            return
        first, now = self.t.next_id("memory_edges", "edge_id"), self.clock()
        given = edges if "confidence" in edges.columns else edges.withColumn("confidence", F.lit(1.0))
        new = self.t.fit("memory_edges", relational.numbered(given, "edge_id", first, "source", "relation", "target"))
        new = new.withColumns({"project": F.lit(project), "memory_id": F.lit(memory_id).cast("long"), "observed_at": F.lit(now).cast("long"), "created_at": F.lit(now).cast("long")})
        new = new.withColumns({"source_norm": normalize_graph_text(F.col("source")), "relation_norm": normalize_relation(F.col("relation")), "target_norm": normalize_graph_text(F.col("target"))})
        self.t.append("memory_edges", self.t.fit("memory_edges", new))
        self.reconcile()

    @writes
    def reconcile(self, dry_run: bool = False) -> DataFrame:
        e = self.t("memory_edges")
        old, now = e.where("superseded_by IS NOT NULL"), graph.reconcile(e.where("superseded_by IS NULL").drop("superseded_by", "superseded_reason"))
        report = now.groupBy("superseded_reason").agg(F.count("*").alias("n"))
        if not dry_run:
            self.t.replace("memory_edges", old.unionByName(self.t.fit("memory_edges", now)))
        return report

    def memory_graph(self, entity: str, day: str | None = None, limit: int = 50) -> DataFrame:
        return graph.for_entity(self.t("memory_edges"), " ".join(entity.lower().split()), limit, day=day)

    # Search

    def search(self, question: str, limit: int = 10, **weights) -> DataFrame:
        """hybrid_search for one question; weights are fields of retrieve.Config, for instance project."""
        q = self.spark.createDataFrame([(1, question)], "query_id long, query string")
        return self.search_many(q, limit, **weights)

    @timed
    def search_many(self, questions: DataFrame, limit: int = 10, **weights) -> DataFrame:
        c = retrieve.Config(now=self.clock(), limit=limit, namespace=self.namespace, **(self.config | weights))
        meta = self.t("memory_meta").select("memory_id", "importance", "scope", "kind", "event_time", "namespace", "trust_tier", "classification", "legal_hold", "expires_at", "tombstoned_at", "trust_last_validated_at", "trust_ref_count", "maturity")
        vectors = asked = None
        if self.embed:
            vectors = self.t("embeddings").where(F.col("model") == self.model)
            asked = questions.select("query_id", self.embed(F.col("query")).alias("embedding"))
        return retrieve.hybrid_search(self.t("memories"), meta, self.t("memory_edges"), questions, c, vectors, asked, chunks=self.t("memory_chunks"), index=self._index, nearest=None if c.project else self._nearest)

    def get_context(self, question: str, limit: int = 10, project: str | None = None) -> DataFrame:
        found = self.search(question, limit, project=project)
        return retrieve.context(found, self.t("memories")).orderBy("place")

    def get_evidence(self, question: str, limit: int = 10, project: str | None = None) -> DataFrame:
        """The memories of a context with their kinds and dates, their chunks and active edges, as retrieve.evidence gives them."""
        placed = cut(retrieve.context(self.search(question, limit, project=project), self.t("memories")), "context")
        return retrieve.evidence(placed, self.t("memories"), self.t("memory_meta"), self.chunks(), self.t("memory_edges"))

    @writes
    def inject(self, limit: int = 10) -> DataFrame:
        """(memory_id, kind, rank0) of the memories to show at a session's start, the profile first; they are noted as shown."""
        adjust = relational.score_adjustments(self.t("injection_events"), self.t("memory_feedback"))
        none = self.spark.createDataFrame([], "memory_id long, relevance double")
        mine = self.t("memories").join(self.live().select("memory_id"), "memory_id", "left_semi")
        ranked = retrieve.injection_rank(mine, self.t("memory_meta"), none, adjust, self.clock(), limit)
        out = cut(retrieve.pin_profile(ranked, self.live().where("kind = 'profile'").orderBy(F.desc("memory_id")).limit(1).select("memory_id", "kind"), limit), "injected")
        ids = [r.memory_id for r in out.orderBy("rank0").collect()]  # at most the limit
        first = self.t.next_id("injection_events", "event_id")
        if ids:
            self.t.append("injection_events", self._rows("injection_events", *[{"event_id": first + i, "memory_id": m, "rank_pos": i, "created_at": self.clock()} for i, m in enumerate(ids)]))
        return out

    def skim(self, memory_id: int) -> DataFrame:
        return self.chunks().where(F.col("memory_id") == memory_id).orderBy("ordinal")

    def expand(self, memory_id: int | None = None, observation_id: int | None = None, digest: str | None = None, most: int = 65_536) -> str | None:
        """The original text of a visible memory's session, of an observation, whole where it was cut, or of a hash; cut at `most` bytes."""
        if memory_id is not None:
            keys = self.chunks().where(F.col("memory_id") == memory_id).select(F.col("source_hash").alias("hash"))
        elif observation_id is not None:
            row = self.t("observations").where(F.col("observation_id") == observation_id).first()
            if row is None or row.output_blob is None:
                return row.output if row else None
            keys = self.spark.createDataFrame([(row.output_blob,)], "hash string")
        else:
            keys = self.spark.createDataFrame([(digest,)], "hash string")
        row = self.t("blobs").join(keys.where("hash IS NOT NULL").distinct(), "hash", "left_semi").select(truncate_bytes(F.col("data"), most).alias("x")).first()
        return row.x if row else None

    def original(self, chunk_id: str) -> str | None:
        """The bytes of a visible chunk's transcript that it stands for."""
        c = self.chunks().where(F.col("chunk_id") == chunk_id).join(self.t("blobs"), F.col("source_hash") == F.col("hash"))
        row = c.select(F.substr(F.col("data").cast("binary"), F.col("start_byte").cast("int") + 1, (F.col("end_byte") - F.col("start_byte")).cast("int")).cast("string").alias("x")).first()
        return row.x if row else None

    # Learning from use

    @writes
    def feedback(self, memory_id: int, signal: str, weight: float) -> None:
        """Clamped to 2 either way; what helps also counts as validated."""
        weight = max(-2.0, min(2.0, weight))
        self.t.append("memory_feedback", self._rows("memory_feedback", {"event_id": self.t.next_id("memory_feedback", "event_id"), "memory_id": memory_id, "signal": signal, "weight": weight, "created_at": self.clock()}))
        if weight > 0:
            mine = F.col("memory_id") == memory_id
            m = self.t("memory_meta")
            self.t.replace("memory_meta", m.withColumns({"trust_ref_count": F.when(mine, F.coalesce("trust_ref_count", F.lit(0)) + 1).otherwise(F.col("trust_ref_count")), "trust_last_validated_at": F.when(mine, self.clock()).otherwise(F.col("trust_last_validated_at"))}))

    @writes
    def promote(self) -> DataFrame:
        ripe = relational.maturity(self.t("memory_meta"), self.t("injection_events"), self.t("memory_feedback"))
        self.t.replace("memory_meta", relational.patched(self.t("memory_meta"), ripe.where("maturity <> 'draft'"), "memory_id"))
        return ripe

    @writes
    def reflect(self, apply: bool = False) -> DataFrame:
        """Proposals from groups of near copies; applied, the sources are marked down."""
        text = self.t("memories").select(F.col("memory_id").alias("leader"), "project", "summary")
        groups = cut(consolidate.greedy_groups(self.live()).join(text, "leader").select("leader", "project", "kind", F.col("memory_ids").alias("source_memory_ids"), F.col("summary").alias("proposed_summary")), "groups")
        if groups.limit(1).count():
            now = {"status": F.lit("applied" if apply else "proposed"), "created_at": F.lit(self.clock()).cast("long")}
            new = relational.numbered(groups, "proposal_id", self.t.next_id("reflection_proposals", "proposal_id"), "leader").withColumns(now)
            self.t.append("reflection_proposals", new if not apply else new.withColumn("applied_at", now["created_at"]))
            if apply:
                down = groups.select(F.explode("source_memory_ids").alias("memory_id"), "project", F.lit("consolidated").alias("signal"), F.lit(-0.5).alias("weight"), now["created_at"].alias("created_at"))
                self.t.append("memory_feedback", relational.numbered(down, "event_id", self.t.next_id("memory_feedback", "event_id"), "memory_id"))
        return self.t("reflection_proposals")

    def corrections(self) -> DataFrame:
        return compress.mine_corrections(self.t("observations"))

    def synthesize(self, generate, most_groups: int = 10) -> list[int]:
        """Inferred memories of groups that share a term: generate(list of summaries) gives lines of facts, or None. They are quarantined."""
        out = []
        for g in consolidate.synthesis_groups(self.live(), groups=most_groups).collect():
            texts = [r.summary for r in self.t("memories").where(F.col("memory_id").isin(*g.memory_ids)).orderBy("memory_id").collect()]
            if said := generate(texts):
                known = self.spark.createDataFrame([(said, texts)], "reply string, inputs array<string>")
                for fact in known.select(consolidate.derived_facts(F.col("reply"), F.col("inputs")).alias("x")).first().x:
                    out.append(self._derive(fact, g.term, g.memory_ids))
        return out

    @writes
    def _derive(self, fact: str, term: str, sources: list[int]) -> int:
        """An inferred memory: quarantined, linked to its sources, entered in the ledger; its sources have been of use."""
        mid = self._add("synthesis", fact, term, None, govern.DERIVED | {"kind": "inference", "parent_memory_id": sources[0]})
        self._add_edges("synthesis", mid, self.spark.createDataFrame([(f"memory:{i}", "derives", f"memory:{mid}") for i in sources], "source string, relation string, target string"))
        self._log("derive", mid, {"sources": sorted(sources)})
        for i in sources:
            self.feedback(i, "derived", 0.5)
        return mid

    # Sweeps, governance, sync

    @timed
    def sweep(self, least: int = 50, idle: int = 1800, limit: int = 20, dry_run: bool = False) -> DataFrame:
        """Compresses open sessions that are idle or long. One that fails is noted and doesn't stop the others."""
        found = relational.sweep_candidates(self.t("sessions"), self.t("observations"), least, self.clock() - idle, limit)
        rows = found.collect()
        status = dict.fromkeys((r.session_id for r in rows), "ok")
        for r in [] if dry_run else rows:
            if not self.lease(r.session_id, "sweep"):
                status[r.session_id] = "skipped"
                continue
            try:
                self.compress(r.session_id)
            except Exception:
                status[r.session_id] = "failed"
            finally:
                self.release(r.session_id, "sweep")
        if rows:
            self._note_sweep(rows, status, dry_run)
        return self.spark.createDataFrame(rows, found.schema)

    @writes
    def _note_sweep(self, rows: list[Row], status: dict[str, str], dry_run: bool) -> None:
        self.t.append("sweep_events", self._rows("sweep_events", *[{"project": r.project, "session_id": r.session_id, "action": "compress", "dry_run": dry_run, "status": status[r.session_id], "reason": r.reason, "subject_last_activity": r.last_activity, "created_at": self.clock()} for r in rows]))

    @writes
    def lease(self, session_id: str, owner: str, seconds: int = 600) -> bool:
        """One holder at a time; a lease that ran out is free."""
        now = self.clock()
        if self.t("sweep_leases").where((F.col("session_id") == session_id) & (F.col("lease_until") > now)).limit(1).count():
            return False
        self.t.upsert("sweep_leases", self._rows("sweep_leases", {"session_id": session_id, "owner": owner, "acquired_at": now, "lease_until": now + seconds}), "session_id")
        return True

    @writes
    def release(self, session_id: str, owner: str) -> None:
        self.t.delete("sweep_leases", self.spark.createDataFrame([(session_id, owner)], "session_id string, owner string"), "session_id", "owner")

    @timed
    def dream(self, project: str, reason: str = "asked") -> dict[str, object]:
        """What is done while a project rests: edges reconciled, near copies proposed, facts derived if there is a model, memories
        promoted, the indexes brought up to date. Noted as a sweep event with the project's last activity, also if it fails."""
        last = self.list_projects().where(F.col("project") == project).first()
        out, status = {}, "failed"
        try:
            self.reconcile()
            out["proposals"] = self.reflect().where(F.col("project") == project).count()
            out["derived"] = self.synthesize(lambda texts: self.generate("What follows from these?\n" + "\n".join(texts))) if self.generate else []
            self.promote()
            out["indexed"] = self.index_all()
            out["embedded"] = self.embed_all() if self.embed else 0
            status = "ok"
        finally:
            with self.t.writing():
                self.t.append("sweep_events", self._rows("sweep_events", {"project": project, "action": "dream", "dry_run": False, "status": status, "reason": reason, "subject_last_activity": last.last_activity if last else None, "created_at": self.clock()}))
        return out

    def dream_idle(self, gap: int = 1800, limit: int = 20) -> dict[str, str]:
        """Dreams once for each project's idle period: of those without activity for `gap` seconds that no dream has seen so, the
        longest idle first. A project whose dream fails is noted and tried again; the others go on."""
        rows = relational.dream_candidates(self.list_projects(), self.t("sweep_events"), self.clock() - gap).limit(limit).collect()
        out = {}
        for r in rows:
            try:
                self.dream(r.project, "idle")
                out[r.project] = "ok"
            except Exception:
                out[r.project] = "failed"
        return out

    def compliance(self) -> dict[str, DataFrame]:
        return {"chains": govern.verify_chain(self.t("memory_ledger")), "inventory": relational.governance_inventory(self.t("memories"), self.t("memory_meta"), self.clock()), "forks": govern.fork_evidence(self.t("memory_ledger"))}

    def lineage(self, memory_id: int) -> dict[str, DataFrame]:
        shown = self.t("injection_events").withColumn("created_ts", F.col("created_at"))
        return govern.lineage_report(memory_id, self.t("memories"), self.t("memory_meta"), self.t("memory_ledger"), shown)

    @writes
    def publish(self, node: str, op: str, payload: dict) -> int:
        """A sync event with the next Lamport time, linked to the one before by its hash."""
        import hashlib

        last = self.t("sync_events").orderBy(F.desc("lamport"), F.desc("created_at")).first()
        n, prev = (last.lamport + 1, last.event_hash) if last else (1, None)
        text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
        digest = hashlib.sha256(json.dumps([node, n, op, text, prev]).encode()).hexdigest()
        self.t.append("sync_events", self._rows("sync_events", {"event_id": uuid.uuid4().hex, "node_id": node, "lamport": n, "op_type": op, "payload": text, "created_at": self.clock(), "prev_hash": prev, "event_hash": digest}))
        return n

    def export_events(self, after: int = 0, limit: int = 1000) -> DataFrame:
        return self.t("sync_events").where(F.col("lamport") > after).orderBy("lamport", "created_at", "event_id").limit(limit)

    @writes
    def import_events(self, events: DataFrame) -> int:
        """Events not yet known are added; returns how many."""
        new = events.dropDuplicates(["event_id"]).join(self.t("sync_events").select("event_id"), "event_id", "left_anti")
        rows = new.count()
        if rows:
            self.t.append("sync_events", new)
        return rows

    @writes
    def snapshot(self, project: str, folder: str, label: str | None = None) -> dict[str, int]:
        """The project's memories with their metadata, entities, chunks, edges and ledger entries, as tables in a folder."""
        out = govern.snapshot({name: self.t(name) for name in (*SNAPSHOT, "memory_ledger")}, project, folder)
        self.t.append("brain_snapshots", self._rows("brain_snapshots", {"snapshot_id": uuid.uuid4().hex, "label": label, "project": project, "memory_count": out["memories"], "edge_count": out["memory_edges"], "created_at": self.clock()}))
        return out

    @writes
    def restore(self, folder: str) -> int:
        """Memories of a snapshot under new ids, with metadata (hold, classification, consent, namespace), chunks and edges.

        The snapshot's ledger entries are evidence and stay in its folder; each restored memory gets an entry of its own.
        """
        tables = govern.restore(self.spark, folder, self.t.next_id("memories", "memory_id") - 1, SNAPSHOT)
        tables["memory_edges"] = relational.numbered(tables["memory_edges"].drop("edge_id").withColumn("_was", F.lit(None)), "edge_id", self.t.next_id("memory_edges", "edge_id"), "observed_at", "memory_id", "source_norm", "target_norm").drop("_was")
        ids = cut(tables["memories"].select("memory_id"), "restored")
        n = ids.count()
        for name in SNAPSHOT:
            self.t.append(name, cut(self.t.fit(name, tables[name]), name))
        blob = self.t("memory_chunks").join(ids, "memory_id", "left_semi").where("source_hash IS NOT NULL").select("memory_id", F.col("source_hash").alias("hash")).distinct().groupBy("hash").agg(F.count("*").alias("more"))
        self.t.replace("blobs", self.t("blobs").join(cut(blob, "more"), "hash", "left").withColumn("refcount", F.col("refcount") + F.coalesce("more", F.lit(0))))
        self._log_all("restore", ids, {"memories": n})
        return n

    def status(self) -> dict[str, int]:
        return {name: self.t(name).count() for name in ("sessions", "observations", "memories", "memory_edges", "memory_chunks", "blobs")}


#: What a snapshot restores.
SNAPSHOT = ("memories", "memory_meta", "memory_entities", "memory_chunks", "memory_edges")


def compress_relations(observations: DataFrame) -> DataFrame:
    """Explicit relation lines of a session's inputs and outputs."""
    text = F.concat_ws("\n", "input", "output")
    return graph.relation_markers(observations.select(text.alias("t")), "t")
