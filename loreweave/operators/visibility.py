"""Which memories a reader may see, and the defaults of those without metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a memory without metadata has.
DEFAULTS = {"importance": 0.5, "scope": "project", "kind": "session", "namespace": "local", "trust_tier": "medium", "classification": "internal", "legal_hold": False, "trust_ref_count": 0, "maturity": "draft"}


def with_meta(memories: DataFrame, meta: DataFrame) -> DataFrame:
    """Memories with their metadata; missing rows and values get the defaults."""
    out = memories.join(meta, "memory_id", "left")
    return out.withColumns({k: F.coalesce(k, F.lit(v).cast(meta.schema[k].dataType)) for k, v in DEFAULTS.items() if k in meta.columns})


def is_live(now: int) -> Column:
    return F.col("tombstoned_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def live(memories: DataFrame, meta: DataFrame, namespace: str, now: int) -> DataFrame:
    """Memories of the namespace that are neither deleted nor expired; one that expires just now is hidden."""
    return with_meta(memories, meta).where((F.col("namespace") == namespace) & is_live(now))


def where_given(df: DataFrame, **conditions) -> DataFrame:
    """df where each named column equals its value; None asks nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [kv for kv in conditions.items() if kv[1] is not None], df)


def recent(rows: DataFrame, limit: int, project: str | None = None) -> DataFrame:
    return where_given(rows, project=project).orderBy(F.desc("created_at"), F.desc("memory_id")).limit(limit)


def recent_scoped(rows: DataFrame, scope: str, limit: int, project: str | None = None) -> DataFrame:
    """The newest of a scope; the user's own are the same in every project."""
    return recent(rows.where(F.col("scope") == scope), limit, None if scope == "user" else project)


def by_kind(memories: DataFrame, meta: DataFrame, kind: str, limit: int, project: str | None = None) -> DataFrame:
    return recent(memories.join(meta, "memory_id").where(F.col("kind") == kind), limit, project)


def without_inference(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("kind", F.lit("")) != "inference")


def consent_ok() -> Column:
    """Health and personal data need consent; everything else passes."""
    return F.coalesce(~F.col("classification").isin("phi", "pii") | (F.col("consent_state") == "granted"), F.lit(False))


def consent_gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(consent_ok()), rows.where(~consent_ok())


def allowed(rows: DataFrame, namespaces: list[str]) -> DataFrame:
    """Rows of the namespaces that an agent may read; an empty list is all."""
    return rows.where(F.col("namespace").isin(*namespaces)) if namespaces else rows
