"""Keeps a full-text index of a growing folder of texts, so that a question reads the postings of its words and no text.

    python -m jobs.index_texts --input /data/documents --output /data/index --checkpoint /data/index-checkpoint

Takes the Parquet files that came since the last run. Each micro-batch is a segment of the index (loreweave.operators.fulltext),
partitioned by a hash of the token; a batch that is run again after a failure writes its segment anew, so nothing counts twice. A
text that comes again later with the same id replaces the one before. Of several texts with one id in one batch the last
in order of their characters stays; rows without an id are left out and counted in the log.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, config_of, stream_path
from loreweave.operators import fulltext

log = logging.getLogger("jobs.index_texts")


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row for each id. Only the texts of ids that come twice are shuffled."""
    twice = rows.groupBy("memory_id").count().where("count > 1").select("memory_id")
    again = rows.join(twice, "memory_id", "left_semi").groupBy("memory_id").agg(F.max("text").alias("text"))
    return rows.join(twice, "memory_id", "left_anti").unionByName(again)


def run(spark: SparkSession, source: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Indexes what is new below source and waits until that is done; returns the batches, rows and texts of this run."""
    c = config_of(__file__, config)
    done = {"batches": 0, "rows": 0, "texts": 0}

    def index(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(c["id"]).cast("long").alias("memory_id"), F.col(c["text"]).cast("string").alias("text"))
        n, named = rows.agg(F.count("*"), F.count("memory_id")).first()
        texts = fulltext.add(one_of_each(rows.where("memory_id IS NOT NULL")), output, number, c["stemming"])
        done.update(batches=done["batches"] + 1, rows=done["rows"] + n, texts=done["texts"] + texts)
        log.info("batch %d: read %d rows from %s (%d without an id), wrote %d texts to segment %d of %s", number, n, source, n - named, texts, number, output)

    rows = spark.readStream.schema(f"`{c['id']}` long, `{c['text']}` string").option("maxFilesPerTrigger", c["files_per_batch"]).option("recursiveFileLookup", "true").parquet(stream_path(source))
    query = rows.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %(rows)d new rows and indexed %(texts)d texts in %(batches)d batches", done)
    return done


if __name__ == "__main__":
    command_line(__doc__.splitlines()[0], run)
