"""Canonical JSON and its hashes: keys in order, nulls kept, no blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreweave.functions.text import normalize_namespace


def canonical(**fields: Column) -> Column:
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def entry_hash(prev_hash: Column, namespace: Column, memory_id: Column, op_type: Column, actor: Column, payload: Column, created_at: Column) -> Column:
    """Hash of a ledger entry over its fields and the hash before it."""
    return F.sha2(canonical(actor=actor, created_at=created_at, memory_id=memory_id, namespace=normalize_namespace(namespace), op_type=op_type, payload=payload, prev_hash=prev_hash), 256)


RECORD_FIELDS = (
    "classification", "consent_state", "expires_at", "kind", "legal_hold", "namespace", "parent_memory_id", "project", "residency",
    "retention_policy_id", "scope", "session_id", "source_ref", "source_type", "summary", "tags", "trust_tier", "writer_identity",
)


def record_hash(**fields: Column) -> Column:
    """Hash of a governed memory over its 18 fields; those not given are null."""
    if extra := set(fields) - set(RECORD_FIELDS):
        raise ValueError(f"not fields of a record: {sorted(extra)}")
    every = {k: fields.get(k, F.lit(None).cast("string")) for k in RECORD_FIELDS}
    every["namespace"] = normalize_namespace(every["namespace"])
    return F.sha2(canonical(**every), 256)
