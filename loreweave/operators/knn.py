"""Nearest neighbours by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.vectors import normalize
from loreweave.operators.search import in_blocks, top

#: Rows of query vectors that are broadcast at once; more are searched block by block.
MOST_QUERIES = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int, include_self: bool = False) -> DataFrame:
    """(query_id, memory_id, similarity, rank0): exact cosine neighbours, ties by id.

    vectors: memory_id, embedding; queries: query_id, embedding, any number, of which MOST_QUERIES rows at a time are sent to
    every task as one matrix. Each batch keeps its k best of each query, so what is shuffled doesn't grow with the vectors of a batch.
    """
    return in_blocks(queries.select("query_id", "embedding"), MOST_QUERIES, lambda found: _nearest(vectors, found, queries.schema["query_id"].dataType, k, include_self))


def _nearest(vectors: DataFrame, found: list[Row], id_type: T.DataType, k: int, include_self: bool) -> DataFrame:
    """The neighbours of one block of queries."""
    import numpy as np
    import pandas as pd

    ids = np.array([r[0] for r in found])
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("memory_id", vectors.schema["memory_id"].dataType), T.StructField("similarity", T.DoubleType())])
    if not len(ids):
        return top(vectors.sparkSession.createDataFrame([], schema), k, "memory_id")

    def unit(x):
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    shared = vectors.sparkSession.sparkContext.broadcast(unit(np.array([r[1] for r in found], float)))

    def search(batches):
        q = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            s = q @ unit(np.stack(pdf["embedding"].to_numpy()).astype(float)).T
            rows = pdf["memory_id"].to_numpy()
            keep = min(len(rows), k + 1)
            for i in range(len(q)):
                least = np.partition(s[i], len(rows) - keep)[len(rows) - keep]
                at = np.flatnonzero(s[i] >= least)
                yield pd.DataFrame({"query_id": ids[i], "memory_id": rows[at], "similarity": s[i][at]})

    hits = vectors.select("memory_id", "embedding").where("embedding IS NOT NULL").mapInPandas(search, schema)
    hits = hits if include_self else hits.where("query_id <> memory_id")
    return top(hits, k, F.desc(F.round("similarity", 9)), "memory_id")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("embedding", normalize(F.col("embedding")))


def backfill(memories: DataFrame, embeddings: DataFrame, model: str, embed) -> DataFrame:
    """Embeddings of memories that the model lacks, from summary and tags."""
    lacking = memories.join(embeddings.where(F.col("model") == model).select("memory_id"), "memory_id", "left_anti")
    return lacking.select("memory_id", F.lit(model).alias("model"), embed(F.concat_ws(" ", "summary", "tags")).alias("embedding"))
