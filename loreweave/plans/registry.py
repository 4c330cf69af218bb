"""Queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreweave.sources.views import NOW, Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Visible memories of the local namespace, as SQL over the views memories and memory_meta.
LIVE = f"""live AS (
  SELECT m.memory_id, m.project, m.session_id, m.summary, m.tags, m.created_at, coalesce(mm.scope, 'project') AS scope, coalesce(mm.kind, 'session') AS kind
  FROM memories m LEFT JOIN memory_meta mm ON mm.memory_id = m.memory_id
  WHERE coalesce(mm.namespace, 'local') = 'local' AND mm.tombstoned_at IS NULL AND (mm.expires_at IS NULL OR mm.expires_at > {NOW}))"""


def query(*views: str, sql: str | None = None):
    """Registers f(t), where t(name) is a table or view; sql is its DuckDB twin over the named views."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views)
        return f

    return register
