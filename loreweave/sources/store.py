"""The memory tables as versioned Parquet folders: append, upsert, patch, delete."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from functools import reduce
from threading import Event, Thread, local

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources.shared import _of

SCHEMAS = {
    "sessions": "session_id string, project string, started_at long, ended_at long, compressed boolean",
    "observations": "observation_id long, session_id string, project string, tool string, input string, output string, created_at long, output_blob string",
    "sweep_events": "project string, session_id string, action string, dry_run boolean, status string, reason string, subject_last_activity long, created_at long",
    "sweep_leases": "session_id string, owner string, acquired_at long, lease_until long",
    "memories": "memory_id long, project string, session_id string, summary string, tags string, created_at long",
    "memory_meta": "memory_id long, importance double, scope string, kind string, event_time string, namespace string, source_type string, trust_tier string, writer_identity string, source_ref string, parent_memory_id long, classification string, consent_state string, retention_policy_id string, expires_at long, legal_hold boolean, record_hash string, tombstoned_at long, tombstone_reason string, trust_last_validated_at long, trust_ref_count long, maturity string",
    "embeddings": "memory_id long, model string, dim int, embedding array<float>",
    "blobs": "hash string, content_type string, orig_len long, data string, refcount long",
    "memory_ledger": "namespace string, id long, memory_id long, op_type string, actor string, payload string, created_at long, prev_hash string, entry_hash string",
    "memory_ledger_epochs": "namespace string, epoch int, start_entry_id long, start_entry_hash string, evidence_sha256 string, created_at long",
    "memory_entities": "memory_id long, entity string",
    "memory_edges": "edge_id long, project string, memory_id long, source string, relation string, target string, source_norm string, relation_norm string, target_norm string, valid_from string, valid_until string, observed_at long, confidence double, superseded_by long, superseded_reason string, created_at long",
    "memory_chunks": "chunk_id string, project string, memory_id long, session_id string, ordinal int, density string, kind string, title string, summary string, source_hash string, start_byte long, end_byte long, token_estimate long, created_at long",
    "injection_events": "event_id long, project string, session_id string, memory_id long, rank_pos int, query string, created_at long",
    "memory_feedback": "event_id long, memory_id long, project string, signal string, weight double, created_at long",
    "code_anchors": "memory_id long, project string, path string, kind string, name string, hash string, start_byte long, end_byte long, shingles array<long>",
    "reflection_proposals": "proposal_id long, project string, kind string, source_memory_ids array<long>, proposed_summary string, status string, created_at long, applied_at long",
    "brain_snapshots": "snapshot_id string, label string, project string, memory_count long, edge_count long, created_at long",
    "sync_events": "event_id string, node_id string, project string, lamport long, op_type string, payload string, created_at long, prev_hash string, event_hash string",
}


_held = local()


def _make(spark: SparkSession, path: str, token: str) -> bool:
    """Makes a file with a token in it, if there is none. Of several that try at once one succeeds."""
    from py4j.protocol import Py4JJavaError

    fs, at = _of(spark, path)
    try:
        if fs.getScheme() == "file":  # here Hadoop looks first and creates then
            jvm = spark.sparkContext._jvm
            fs.mkdirs(at.getParent())
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(at.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        out = fs.create(at, fs.getScheme() == "file")
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(token.encode()))
    out.close()
    return True


def _said(fs, at) -> str | None:
    from py4j.protocol import Py4JJavaError

    try:
        source = fs.open(at)
    except Py4JJavaError:  # it is gone
        return None
    raw = bytearray(source.readNBytes(64))
    source.close()
    return raw.decode()


def _age(fs, at) -> float:
    from py4j.protocol import Py4JJavaError

    try:
        return time.time() - fs.getFileStatus(at).getModificationTime() / 1000
    except Py4JJavaError:  # it is gone
        return 0.0


def _break(spark: SparkSession, path: str, patience: float) -> None:
    """Deletes the file of a dead holder; of several waiters one does, under a file of its own."""
    fs, at = _of(spark, path)
    breaker = _of(spark, f"{path}.break")[1]
    if _age(fs, at) > patience and _make(spark, f"{path}.break", ""):
        if _age(fs, at) > patience:
            fs.delete(at, False)
        fs.delete(breaker, False)
    elif _age(fs, breaker) > patience:  # who made it died within these lines
        fs.delete(breaker, False)


def _renew(fs, at, done: Event, every: float) -> None:
    from py4j.protocol import Py4JError

    while not done.wait(every):
        try:
            fs.setTimes(at, int(time.time() * 1000), -1)
        except Py4JError:  # the file is gone: its holder learns that
            return


class Store:
    """Tables below a root folder. A write makes a new version beside the old one and then points to it, so readers of the
    old version go on, and a writer that dies leaves it in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self, name: str) -> tuple[str | None, int]:
        """The newest version of a table and its number: the names of its pointers say them, so no job reads anything."""
        fs, pattern = _of(self.spark, f"{self.root}/_versions/{name}-*")
        found = [s.getPath().getName().split("-") for s in fs.globStatus(pattern) or []]
        newest = max(((int(n), version) for _, n, version in found), default=None)
        return (newest[1], newest[0]) if newest else (None, 0)

    def __call__(self, name: str) -> DataFrame:
        version, _ = self._current(name)
        schema = SCHEMAS[name]
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{version}")

    def replace(self, name: str, rows: DataFrame) -> None:
        _, n = self._current(name)
        version = uuid.uuid4().hex
        self.fit(name, rows).write.parquet(f"{self.root}/{name}/{version}")
        self._point(name, version, n + 1)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds files to the current version."""
        version, n = self._current(name)
        if version is None:
            return self.replace(name, rows)
        self.fit(name, rows).write.mode("append").parquet(f"{self.root}/{name}/{version}")
        return None

    def _point(self, name: str, version: str, n: int) -> None:
        fs, at = _of(self.spark, f"{self.root}/_versions/{name}-{n:09d}-{version}")
        fs.createNewFile(at)

    def fit(self, name: str, rows: DataFrame) -> DataFrame:
        """rows in the table's columns; those they lack are null."""
        have = set(rows.columns)
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema.fields
        return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    def upsert(self, name: str, rows: DataFrame, *keys: str) -> None:
        rows = self.fit(name, rows)
        self.replace(name, self(name).join(rows.select(*keys), list(keys), "left_anti").unionByName(rows))

    def delete(self, name: str, gone: DataFrame, *keys: str) -> None:
        self.replace(name, self(name).join(gone.select(*keys), list(keys), "left_anti"))

    def patch(self, name: str, condition, **values) -> None:
        df = self(name)
        self.replace(name, reduce(lambda d, kv: d.withColumn(kv[0], F.when(condition, F.lit(kv[1])).otherwise(F.col(kv[0]))), values.items(), df))

    @contextmanager
    def lock(self, name: str, patience: float = 60.0):
        """One holder at a time, of all processes: who makes the lock's file. The same thread may enter again.

        A holder renews the file's time while it works, so a file that wasn't renewed for `patience` seconds is a dead
        holder's, and one waiter deletes it. A holder deletes its own file alone, and learns if it lost it.
        """
        held = _held.__dict__.setdefault("locks", {})
        path = f"{self.root}/_locks/{name}"
        if path in held:
            yield
            return
        fs, at = _of(self.spark, path)
        token = uuid.uuid4().hex
        while not _make(self.spark, path, token):
            _break(self.spark, path, patience)
            time.sleep(0.05)
        done = Event()
        Thread(target=_renew, args=(fs, at, done, patience / 6), daemon=True).start()
        held[path] = token
        try:
            yield
        finally:
            del held[path]
            done.set()
            mine = _said(fs, at) == token
            if mine:
                fs.delete(at, False)
        if not mine:
            raise RuntimeError(f"the lock {name} was lost to another holder")

    def writing(self, patience: float = 60.0):
        """The lock of all that reads tables and then writes them: numbers, versions and chains are given out by one writer at a time."""
        return self.lock("writer", patience)

    def next_id(self, name: str, column: str) -> int:
        return (self(name).agg(F.max(column)).first()[0] or 0) + 1
