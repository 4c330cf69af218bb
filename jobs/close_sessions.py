"""Closes idle sessions of a growing event log and writes them by day: what a sweep then turns into memories.

    python -m jobs.close_sessions --input /data/events --output /data/sessions --checkpoint /data/sessions-checkpoint

Takes the Parquet files that came since the last run. Events that are delivered twice count once; a session ends with a pause longer
than `gap`, and is written once, when the newest event is later than its end by `gap` and `late`. Sessions that are
still open are state of the checkpoint and go on in the next run. Events that are more than `late` older than the newest
one of an earlier run are too late for any session: they stay in the input, and the log counts them.
"""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, config_of, stream_path
from loreweave.streaming import logs

log = logging.getLogger("jobs.close_sessions")

SCHEMA = "{key} long, started_at timestamp_ntz, last_activity timestamp_ntz, n_events long, n_kinds long, n_failures long, first_id long, last_id long, reason string, day string"


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Closes what is idle below source and waits until that is done; returns the rows read, too late and written by this run."""
    c = config_of(__file__, config)
    events = spark.readStream.schema(f"`{c['id']}` long, `{c['key']}` long, `{c['time']}` timestamp_ntz, `{c['kind']}` string").option("recursiveFileLookup", "true").parquet(stream_path(source))
    events = events.select(F.col(c["id"]).alias("event_id"), F.col(c["key"]).alias("key"), F.col(c["kind"]).alias("kind"), logs.instant(f"`{c['time']}`").alias("ts"))
    more = [
        F.size(F.collect_set("kind")).cast("long").alias("n_kinds"),  # kinds are few
        F.count_if(F.col("kind").isin(c["failures"])).alias("n_failures"),
        F.min("event_id").alias("first_id"),
        F.max("event_id").alias("last_id"),
    ]
    sessions = logs.idle_or_volume(logs.import_once(events.where("ts IS NOT NULL"), c["late"]), c["volume"], c["gap"], None, "key", more)
    sessions = sessions.withColumns({x: logs.zoneless(x) for x in ("started_at", "last_activity")})
    sessions = sessions.withColumn("day", F.col("started_at").cast("date").cast("string")).withColumnRenamed("key", c["key"])
    dealt = sessions.repartition("day", F.pmod(F.hash(c["key"]), F.lit(c["tasks_per_day"])))
    query = dealt.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    done = {"rows": 0, "late": 0, "batches": 0}
    for p in query.recentProgress:
        done["rows"] += p.numInputRows
        done["late"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        done["batches"] += 1
    log.info("read %(rows)d new events from %%s in %(batches)d batches, %(late)d of them too late; wrote closed sessions to %%s" % done, source, output)
    return done


def read(spark: SparkSession, output: str, key: str = "user_id"):
    """The sessions that were written."""
    return spark.read.schema(SCHEMA.format(key=key)).parquet(output)


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], run)
