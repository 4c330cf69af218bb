"""Evidence lines for a reranker, its answer parsed, and its order fused with the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import dates
from loreweave.functions.text import clip_words, event_terms
from loreweave.operators import fusion
from loreweave.operators.search import of, top
from loreweave.sources.shared import cut

#: Chunks and edges that a memory's evidence names, and words of its text.
MOST_CHUNKS, MOST_EDGES, MOST_WORDS = 3, 4, 60
LABELS = {"temporal": "temporal", "multi_hop": "multi-hop", "single_hop": "single-hop", "open_domain": "open-domain"}


def evidence(found: DataFrame, queries: DataFrame, memories: DataFrame, meta: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, memory_id, rank0, evidence): one line of each found memory's text, kind, time, chunks and edges.

    found: query_id, route, memory_id, rank0. Its memories are few, so chunks and edges are reduced to them first.
    """
    found = cut(found.select("query_id", "route", "memory_id", "rank0"), "found")
    ids = found.select("memory_id").distinct()
    c = top(of(chunks, found).select("memory_id", "ordinal", "title"), MOST_CHUNKS, "ordinal", by="memory_id").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "title"))).alias("cs"))
    e = top(edges.where("superseded_by IS NULL").join(ids, "memory_id"), MOST_EDGES, F.desc("confidence"), F.desc("observed_at"), F.desc("edge_id"), by="memory_id")
    said = F.concat_ws(" ", "source", F.replace("relation", F.lit("_"), F.lit(" ")), "target")
    e = e.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("rank0", said.alias("said")))).alias("es"))
    rows = found.join(queries.select("query_id", "query"), "query_id").join(of(memories, found).select("memory_id", "summary"), "memory_id").join(meta.select("memory_id", "kind", "event_time"), "memory_id", "left")
    rows = rows.join(c, "memory_id", "left").join(e, "memory_id", "left")
    label = F.col("route")
    for k, v in LABELS.items():
        label = F.when(F.col("route") == k, v).otherwise(label)
    near = dates.proximity(dates.query_anchor(F.col("query")), dates.event_date(F.col("event_time")))
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("route="), label),
        F.concat(F.lit("kind="), F.coalesce("kind", F.lit("session"))),
        F.concat(F.lit("time="), F.col("event_time"), F.when(near >= 4, " (close)").when(near > 0, " (near)").otherwise("")),
        F.concat(F.lit("chunks="), F.array_join(F.col("cs.title"), "; ")),
        F.concat(F.lit("edges="), F.array_join(F.col("es.said"), "; ")),
        clip_words(F.regexp_replace("summary", r"\s+", " "), MOST_WORDS),
    )
    return rows.select("query_id", "memory_id", "rank0", line.alias("evidence"))


def parse_order(reply: Column, n: Column) -> Column:
    """The numbers from 1 to n that a reply names, each once, in order."""
    found = F.transform(F.regexp_extract_all(reply, F.lit("([0-9]{1,9})"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: x.between(1, n)))


def fuse_replies(found: DataFrame, replies: DataFrame) -> DataFrame:
    """found fused with the orders of replies (query_id, reply) that number its memories from 1."""
    n = found.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    order = replies.join(n, "query_id").select("query_id", F.posexplode(parse_order(F.col("reply"), F.col("n"))).alias("place", "number"))
    named = order.join(found.withColumn("number", (F.col("rank0") + 1).cast("int")), ["query_id", "number"]).select("query_id", F.lit(1).alias("list_no"), F.lit(1).alias("weight"), "memory_id", F.col("place").cast("long").alias("rank0"))
    return fusion.rrf(found.select("query_id", F.lit(0).alias("list_no"), F.lit(1).alias("weight"), "memory_id", F.col("rank0").cast("long").alias("rank0")).unionByName(named))


def cascade(found: DataFrame, margin: float, dear, budget: int | None = None) -> DataFrame:
    """(query_id, memory_id, rank0, escalated): found (query_id, memory_id, score) in the order of its scores, ties by id; where the
    two best are closer than the margin, in the order of a dear scorer instead.

    dear(rows) gives (query_id, memory_id, score) for all memories of those questions. budget: at most so many questions, those
    with the smallest margins, go there. A question with one memory never does.
    """
    order = (F.desc("score"), "memory_id")
    cheap = top(found.select("query_id", "memory_id", "score"), 1 << 30, *order)
    first, second = (F.max(F.when(F.col("rank0") == i, F.col("score"))) for i in (0, 1))
    close = cheap.where("rank0 < 2").groupBy("query_id").agg((first - second).alias("gap")).where(F.col("gap") < margin)
    close = close if budget is None else close.orderBy("gap", "query_id").limit(budget)
    close = cut(close.select("query_id"), "close")
    again = top(dear(found.join(close, "query_id", "left_semi")).select("query_id", "memory_id", "score"), 1 << 30, *order)
    return cheap.join(close, "query_id", "left_anti").withColumn("escalated", F.lit(False)).unionByName(again.withColumn("escalated", F.lit(True))).drop("score")


def follow_up_prompt(query: Column, evidence_lines: Column) -> Column:
    return F.concat(F.lit("Question: "), query, F.lit("\nKnown:\n"), F.array_join(F.transform(evidence_lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\nWhat else must be looked up? Answer with one question, or NONE."))


def parse_follow_up(reply: Column) -> Column:
    """The first line of a reply that says something; NONE is nothing."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(F.regexp_replace(x, r'^[\s"\-*]+|["\s]+$', ""))), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    return F.when(F.upper(first) != "NONE", first)


def shared_terms(found: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """found with n_shared and n_terms: what the source-fact floor asks for."""
    rows = found.join(queries.select("query_id", "query"), "query_id").join(memories.select("memory_id", "summary"), "memory_id")
    terms = event_terms(F.col("query"))
    return rows.select(*found.columns, F.size(F.array_intersect(terms, event_terms(F.col("summary")))).alias("n_shared"), F.size(terms).alias("n_terms"))
