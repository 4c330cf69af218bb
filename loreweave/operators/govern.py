"""The hash-chained ledger, lineage, and the reports over them."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.hashing import entry_hash
from loreweave.operators.relational import numbered
from loreweave.sources.shared import cut

ENTRY = "namespace string, id long, memory_id long, op_type string, actor string, payload string, created_at long, prev_hash string, entry_hash string"


# What governed fields may say.
VALUES = {
    "source_type": ("user_input", "tool_output", "agent_generated", "derived", "external", "sync_peer"),
    "trust_tier": ("high", "medium", "low", "untrusted"),
    "classification": ("public", "internal", "confidential", "restricted", "phi", "pii"),
    "consent_state": ("required", "granted", "denied", "withdrawn"),
}
#: What a memory has that was asked for, compressed from a session, or derived from others.
EXPLICIT = {"source_type": "user_input", "trust_tier": "high", "writer_identity": "remember"}
COMPRESSED = {"source_type": "derived", "trust_tier": "medium", "writer_identity": "compress"}
DERIVED = {"source_type": "derived", "trust_tier": "medium", "writer_identity": "derive"}


def checked(fields: dict) -> dict:
    """fields, whose governed ones must have one of their VALUES or none."""
    for name, known in VALUES.items():
        if fields.get(name) is not None and fields[name] not in known:
            raise ValueError(f"{name} is one of {', '.join(known)}, not {fields[name]!r}")
    return fields


def build_chain(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Ledger entries of events (namespace, id, memory_id, op_type, actor, payload, created_at), each hashed with the one before.

    heads (namespace, entry_hash) are the last entries of chains that go on. A hash needs the one before, so a namespace's entries
    pass through one task, in order of id and a batch at a time; namespaces are parallel.
    """
    cols = ["namespace", "id", "memory_id", "op_type", "actor", "payload", "created_at"]
    rows = events.select(*cols)
    rows = rows.withColumn("_head", F.lit(None).cast("string")) if heads is None else rows.join(heads.select("namespace", F.col("entry_hash").alias("_head")), "namespace", "left")

    def chain(batches):
        at, prev = object(), None
        for batch in batches:
            before, now = [], []
            for r in batch.to_pylist():
                if r["namespace"] != at:
                    at, prev = r["namespace"], r["_head"]
                body = {"actor": r["actor"], "created_at": r["created_at"], "memory_id": r["memory_id"], "namespace": at, "op_type": r["op_type"], "payload": r["payload"], "prev_hash": prev}
                before.append(prev)
                prev = hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
                now.append(prev)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(before, pa.string()), pa.array(now, pa.string())], [*cols, "prev_hash", "entry_hash"])

    kinds = "namespace string, id long, memory_id long, op_type string, actor string, payload string, created_at long"
    typed = rows.selectExpr(*[f"CAST({k.split()[0]} AS {k.split()[1]}) AS {k.split()[0]}" for k in kinds.split(", ")], "_head")
    return typed.repartition("namespace").sortWithinPartitions("namespace", "id").mapInArrow(chain, ENTRY)


#: Ids of a namespace whose entries are checked together; between such stretches only their last entries are compared.
SPAN = 100_000


def linked(ledger: DataFrame, span: int = SPAN) -> DataFrame:
    """Ledger entries with _before, the hash of the entry before by id (ties by hash) in the namespace, null for the first.

    Stretches of `span` ids are gone through apart from each other, so that a long chain is spread over the tasks; where they
    meet, the last entries of stretches, one row each, give the hash before.
    """
    rows = ledger.withColumn("_stretch", F.floor(F.col("id") / span))
    w = Window.partitionBy("namespace", "_stretch").orderBy("id", "entry_hash")
    last = rows.groupBy("namespace", "_stretch").agg(F.max_by("entry_hash", F.struct("id", "entry_hash")).alias("_last"))
    seams = last.select("namespace", "_stretch", F.lag("_last").over(Window.partitionBy("namespace").orderBy("_stretch")).alias("_seam"))
    rows = rows.withColumns({"_inside": F.lag("entry_hash").over(w), "_first": F.row_number().over(w) == 1}).join(seams, ["namespace", "_stretch"])
    return rows.withColumn("_before", F.when(F.col("_first"), F.col("_seam")).otherwise(F.col("_inside"))).drop("_stretch", "_inside", "_first", "_seam")


def _again():
    return entry_hash(*[F.col(c) for c in ("prev_hash", "namespace", "memory_id", "op_type", "actor", "payload", "created_at")])


def verify_chain(ledger: DataFrame, span: int = SPAN) -> DataFrame:
    """(namespace, n_entries, n_broken, first_broken): links and hashes re-derived, all stretches of a chain at once."""
    rows = linked(ledger, span).withColumn("_ok", F.col("prev_hash").eqNullSafe(F.col("_before")) & (F.col("entry_hash") == _again()))
    return rows.groupBy("namespace").agg(F.count("*").alias("n_entries"), F.count_if(~F.col("_ok")).alias("n_broken"), F.min(F.when(~F.col("_ok"), F.col("id"))).alias("first_broken"))


def verify_epoch(ledger: DataFrame, epochs: DataFrame, span: int = SPAN) -> DataFrame:
    """verify_chain of each namespace's newest epoch (namespace, epoch, start_entry_id); its first entry may point before it."""
    start = epochs.groupBy("namespace").agg(F.max_by("start_entry_id", "epoch").alias("_start"))
    rows = linked(ledger.join(start, "namespace").where(F.col("id") >= F.col("_start")), span)
    joined = F.col("_before").isNull() | F.col("prev_hash").eqNullSafe(F.col("_before"))
    rows = rows.withColumn("_ok", joined & (F.col("entry_hash") == _again()))
    return rows.groupBy("namespace").agg(F.count("*").alias("n_entries"), F.count_if(~F.col("_ok")).alias("n_broken"))


def forks(ledger: DataFrame) -> DataFrame:
    """(namespace, prev_hash, entry_ids) where more than one entry follows another."""
    g = ledger.groupBy("namespace", "prev_hash").agg(F.array_sort(F.collect_list("id")).alias("entry_ids"))
    return g.where(F.size("entry_ids") > 1)


def fork_evidence(ledger: DataFrame) -> DataFrame:
    """(namespace, prev_hash, entries, evidence_sha256): the entries (id, entry_hash) that follow one entry, and a hash over them.

    The hash is of the namespace, the hash before, and the entries' hashes in order of id, joined by newlines: who holds the
    entries can derive it again.
    """
    entry = F.struct("id", "entry_hash")
    twice = forks(ledger).select("namespace", "prev_hash")
    rows = ledger.join(twice, (ledger["namespace"] == twice["namespace"]) & ledger["prev_hash"].eqNullSafe(twice["prev_hash"]), "left_semi")
    g = rows.groupBy("namespace", "prev_hash").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    said = F.concat_ws("\n", "namespace", F.coalesce("prev_hash", F.lit("")), F.array_join(F.transform("entries", lambda e: e["entry_hash"]), "\n"))
    return g.withColumn("evidence_sha256", F.sha2(said, 256))


def tips(ledger: DataFrame) -> DataFrame:
    """Entries that none follows."""
    return ledger.join(ledger.where("prev_hash IS NOT NULL").select(F.col("prev_hash").alias("entry_hash")), "entry_hash", "left_anti")


def lineage(meta: DataFrame, most: int = 32) -> DataFrame:
    """(memory_id, depth, ancestor_id) of each memory's parents, up to `most` deep; a cycle ends where it closes."""
    return meta.sparkSession.sql(
        """
        WITH RECURSIVE up(memory_id, depth, ancestor_id, path) AS (
          SELECT memory_id, 1, parent_memory_id, array(memory_id, parent_memory_id) FROM {meta} WHERE parent_memory_id IS NOT NULL
          UNION ALL
          SELECT u.memory_id, u.depth + 1, m.parent_memory_id, array_append(u.path, m.parent_memory_id)
          FROM up u JOIN {meta} m ON m.memory_id = u.ancestor_id
          WHERE m.parent_memory_id IS NOT NULL AND u.depth < {most} AND NOT array_contains(u.path, m.parent_memory_id))
        SELECT memory_id, depth, ancestor_id FROM up""",
        meta=meta.select("memory_id", "parent_memory_id"),
        most=most,
    )


def lineage_report(memory_id: int, memories: DataFrame, meta: DataFrame, ledger: DataFrame, injections: DataFrame, most: int = 200) -> dict[str, DataFrame]:
    """What is known of one memory: itself, its parents, its ledger entries, and when it was shown."""
    mine = lambda df: df.where(F.col("memory_id") == memory_id)
    return {
        "memory": mine(memories).join(mine(meta), "memory_id", "left"),
        "parents": mine(lineage(meta)).orderBy("depth"),
        "ledger": mine(ledger).orderBy("id"),
        "injections": mine(injections).orderBy(F.desc("created_ts"), F.desc("event_id")).limit(most),
    }


def snapshot(tables: dict[str, DataFrame], project: str, folder: str) -> dict[str, int]:
    """Writes the project's rows of each table to the folder; returns their counts.

    Tables without a project have the rows of the project's memories (table "memories").
    """
    out = {}
    ids = tables["memories"].where(F.col("project") == project).select("memory_id")
    for name, df in tables.items():
        rows = df.where(F.col("project") == project) if "project" in df.columns else df.join(ids, "memory_id", "left_semi")
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    return out


def restore(spark, folder: str, offset: int, names: tuple[str, ...] = ("memories", "memory_edges")) -> dict[str, DataFrame]:
    """Tables of a snapshot with new memory ids, from offset + 1 in the order of the old ones, also in chunk ids and as parents.

    A parent or an edge's memory that the snapshot doesn't have keeps its id.
    """
    m = spark.read.parquet(f"{folder}/memories")
    new = numbered(m.select("memory_id"), "_new", offset + 1, "memory_id")
    new = cut(new, "new-ids")
    out = {}
    for name in names:
        rows = spark.read.parquet(f"{folder}/{name}").join(new, "memory_id", "left").withColumn("_id", F.coalesce("_new", "memory_id"))
        if "chunk_id" in rows.columns:
            rows = rows.withColumn("chunk_id", F.regexp_replace("chunk_id", r"^mem:[0-9]+:", F.concat(F.lit("mem:"), F.col("_id").cast("string"), F.lit(":"))))
        if "parent_memory_id" in rows.columns:
            parents = new.select(F.col("memory_id").alias("parent_memory_id"), F.col("_new").alias("_parent"))
            rows = rows.join(parents, "parent_memory_id", "left").withColumn("parent_memory_id", F.coalesce("_parent", "parent_memory_id")).drop("_parent")
        out[name] = rows.drop("memory_id", "_new").withColumnRenamed("_id", "memory_id")
    return out


def new_epochs(ledger: DataFrame, epochs: DataFrame, now: int) -> DataFrame:
    """An epoch for each namespace that starts at its last entry, with a hash of what came before as evidence."""
    e = ledger.groupBy("namespace").agg(F.max_by(F.struct("id", "entry_hash"), "id").alias("head"), F.count("*").alias("n"))
    last = epochs.groupBy("namespace").agg(F.max("epoch").alias("epoch"))
    evidence = F.sha2(F.concat_ws("|", "namespace", F.col("n").cast("string"), "head.entry_hash"), 256)
    return e.join(last, "namespace", "left").select("namespace", (F.coalesce("epoch", F.lit(0)) + 1).alias("epoch"), F.col("head.id").alias("start_entry_id"), F.col("head.entry_hash").alias("start_entry_hash"), evidence.alias("evidence_sha256"), F.lit(now).cast("long").alias("created_at"))


def report(ledger: DataFrame, inventory: DataFrame) -> str:
    """Markdown of chains and inventory; both have one row per namespace or group of a namespace."""
    from loreweave.sources.files import markdown

    chains = verify_chain(ledger).orderBy("namespace")
    ok = "all chains hold" if not chains.where("n_broken > 0").limit(1).count() else "broken chains"
    return f"# Compliance\n\n{ok}\n\n{markdown(chains)}\n{markdown(inventory.orderBy('namespace', 'classification', 'consent_state'))}"
