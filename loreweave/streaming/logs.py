"""Structured Streaming over the append-only logs: sessions, idempotent import, volume and idle closing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import truncate_bytes


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream of events (parquet) with ts as a timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def instant(c: str) -> Column:
    """The moment of a time without a zone, which is one of UTC, whatever the session's zone."""
    return F.expr(f"make_timestamp(year({c}), month({c}), day({c}), hour({c}), minute({c}), extract(SECOND FROM {c}), 'UTC')")


def zoneless(c: str) -> Column:
    """The time of a moment in UTC, without a zone."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(unix_micros({c}) AS DECIMAL(20, 0)) / 1000000)")


def sessionize(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes", key: str = "user_id", more: Sequence[Column] = ()) -> DataFrame:
    """Sessions by idle gap: a pause of exactly the gap still belongs to the session. Batch and stream alike.

    more: further aggregates of a session's events. A stream hands a session on once, when no event can come that belongs to it:
    the newest event is then later than its end by the gap and `late`, which is None where the events have a watermark.
    Events without a time belong to none.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    out = rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"), *more)
    return out.select(key, F.col("w.start").alias("started_at"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("last_activity"), *[c for c in out.columns if c not in (key, "w")])


def import_once(events: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Each event once, however often it is delivered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def truncated(observations: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Observations with outputs cut at `most` bytes, and the whole outputs of those that were cut, by hash."""
    big = F.octet_length("output") > most
    kept = observations.withColumns({"output_blob": F.when(big, F.sha2("output", 256)), "output": truncate_bytes(F.col("output"), most)})
    return kept, observations.where(big).select(F.sha2("output", 256).alias("hash"), F.col("output").alias("data"))


def idle_or_volume(events: DataFrame, volume: int, gap: str = "30 minutes", late: str | None = "10 minutes", key: str = "user_id", more: Sequence[Column] = ()) -> DataFrame:
    """Closed sessions with the reason: idle, or volume where they have many events."""
    s = sessionize(events, gap, late, key, more)
    return s.withColumn("reason", F.when(F.col("n_events") >= volume, "idle,volume").otherwise("idle"))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns its result, for tests and back-fills."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def duration_seconds(text):
    """30s, 15m, 6h, 2d, 1w as seconds; anything else is null."""
    n, unit = F.regexp_extract(text, r"^\s*([0-9]+)\s*([smhdw])\s*$", 1), F.regexp_extract(text, r"^\s*([0-9]+)\s*([smhdw])\s*$", 2)
    per = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return n.try_cast("long") * per
