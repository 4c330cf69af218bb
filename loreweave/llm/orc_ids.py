"""Token ids in ORC: integer run-length encoding, row indexes, and Bloom filters on document ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.llm.common import cut, parallelism, pick
from loreweave.llm.tokens import encoder

END_ID = 2
#: Rows that are encoded and handed on together.
ROWS = 512

#: Stripes are read in parallel; the row index and the Bloom filter let a search by id pass over the rest.
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.encoding.strategy": "COMPRESSION",
    "compression": "snappy",
}

SCHEMA = "doc_id long, part int, part_start long, ids array<int>"


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID, ordinary: bool = False) -> DataFrame:
    """Rows in ascending order of doc_id: range partitions in order, each with its running count of ids."""

    def run(batches):
        ids_of = encoder(tokenizer, False, ordinary).encode
        end = np.array([end_id], "<u4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = [x + end for x in ids_of(some.column("text").to_pylist())]
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
                values = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + ends[:-1]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))],
                    ["doc_id", "part", "part_start", "ids"],
                )
                start += int(ends[-1])

    docs = pick(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    n = parallelism(docs.sparkSession)
    #: Rows of one id go in the order of the input, also to more than one partition. The sample for the ranges reads no text.
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    return docs.repartitionByRange(n, "doc_id", "_row").sortWithinPartitions("doc_id", "_row").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, ordinary: bool = False) -> None:
    """Writes the ids of every whole text of docs (doc_id, text), each with end_id, in ascending order of doc_id.

    Null and empty texts are end_id alone. Null ids come first. Rows with one id twice are written each, in the order of the input.
    tokenizer: a file that every executor can read. ordinary: strings of special tokens are ordinary text, not their ids.
    """
    encode(docs, tokenizer, end_id, ordinary).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, part_start, ids; a filter on doc_id reads only the row groups that may have it."""
    return spark.read.schema(SCHEMA).orc(path)


def _digests(batches):
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
            ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of what the files hold. No rows: no rows."""
    rows = cut(read(spark, path).mapInArrow(_digests, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"), "digests")
    #: One row per written part: as many as the files, not as the documents.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
