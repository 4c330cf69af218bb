"""A stored full-text index: postings and lengths as partitioned Parquet, added to in segments, of which a question reads its words alone.

    <path>/lengths/segment=N/           memory_id, length (null: the memory is gone)
    <path>/postings/bucket=B/segment=N/ token, memory_id, tf; sorted by token, so that row groups of other tokens are passed over

A segment is written whole, in place of what an interrupted run left of it. What a later segment says of a memory replaces what
earlier ones said, so texts that changed and memories that went need no rewriting; `compact` leaves both out of a new index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.search import counted
from loreweave.sources.shared import cut, discard

#: Folders by a hash of the token: of so many, a question reads at most one for each of its words.
BUCKETS = 64
#: Tokens that are looked up in the statistics of files and row groups; more are only met by a join.
MOST_LOOKED_UP = 1000

LENGTHS = "memory_id long, length int, segment int"
POSTINGS = "token string, memory_id long, tf int, bucket int, segment int"


def bucket_of(token: Column) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % BUCKETS).cast("int")


def _save(lengths: DataFrame, postings: DataFrame, path: str, segment: int) -> None:
    """Writes a segment's partitions and no others. A token's rows go to as many tasks as their size asks for."""
    out = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    rows = postings.withColumn("bucket", bucket_of(F.col("token"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "memory_id")
    out(rows.select("token", "memory_id", "tf", "bucket", F.lit(segment).alias("segment")), "bucket", "segment").parquet(f"{path}/postings")
    out(lengths.select("memory_id", "length", F.lit(segment).alias("segment")), "segment").parquet(f"{path}/lengths")


def add(texts: DataFrame, path: str, segment: int, stemming: bool = True) -> int:
    """Indexes texts (memory_id, text) as a segment; returns how many. Null and empty texts have a length of 0. Ids occur once.

    Lengths are written last, and what has no length isn't read, so a segment counts once it is whole.
    """
    rows = cut(counted(texts.select(F.col("memory_id").cast("long").alias("memory_id"), "text"), None, stemming), "segment")
    _save(rows, rows.select("memory_id", F.inline("hits")), path, segment)
    n = rows.count()
    discard(rows)
    return n


def remove(gone: DataFrame, path: str, segment: int) -> None:
    """A segment that says that memories (memory_id) are gone."""
    spark = gone.sparkSession
    _save(gone.select(F.col("memory_id").cast("long").alias("memory_id"), F.lit(None).cast("int").alias("length")).distinct(), spark.createDataFrame([], "token string, memory_id long, tf int"), path, segment)


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(f"{path}/{name}")
    except AnalysisException:  # nothing was added yet
        return spark.createDataFrame([], schema)


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(memory_id, length, segment) of the memories that are there, each from its last segment."""
    last = _read(spark, path, "lengths", LENGTHS).groupBy("memory_id").agg(F.max_by(F.struct("length", "segment"), "segment").alias("l"))
    return last.select("memory_id", "l.length", "l.segment").where("length IS NOT NULL")


def postings(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """(memory_id, length, token, tf) of the memories that are there, or of asked (token) alone.

    Up to MOST_LOOKED_UP tokens are looked up: only their folders and row groups are read. More meet the postings by a join.
    """
    rows = _read(spark, path, "postings", POSTINGS)
    if asked is not None:
        asked = asked.select("token").distinct()
        known = asked.select("token", bucket_of(F.col("token")).alias("bucket")).limit(MOST_LOOKED_UP + 1).collect()
        if len(known) <= MOST_LOOKED_UP:
            buckets, tokens = sorted({r.bucket for r in known}), sorted(r.token for r in known)
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens)) if known else rows.limit(0)
        else:
            rows = rows.join(asked, "token", "left_semi")
    return rows.join(lengths(spark, path), ["memory_id", "segment"]).select("memory_id", "length", "token", "tf")


def ready(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """What search.index gives, from the stored index: (memory_id, length, hits) with the tokens of asked (token).

    Texts are not read.
    """
    hits = postings(spark, path, asked).groupBy("memory_id").agg(F.collect_list(F.struct("token", "tf")).alias("hits"))
    none = F.array().cast("array<struct<token:string,tf:int>>")
    return cut(lengths(spark, path).select("memory_id", "length").join(hits, "memory_id", "left").withColumn("hits", F.coalesce("hits", none)), "ready")


def next_segment(spark: SparkSession, path: str) -> int:
    """One more than the last; for a single writer."""
    last = _read(spark, path, "lengths", LENGTHS).agg(F.max("segment")).first()[0]
    return 0 if last is None else last + 1


def indexed(spark: SparkSession, path: str) -> int | None:
    """The largest id that was ever indexed."""
    return _read(spark, path, "lengths", LENGTHS).agg(F.max("memory_id")).first()[0]


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the index to a new folder as one segment, without what was replaced or is gone. Readers then take the new folder."""
    rows = postings(spark, path).drop("length")
    _save(lengths(spark, path).select("memory_id", "length"), rows, to, 0)
