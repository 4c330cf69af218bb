"""Lexical recall: stemmed full text with BM25, substring recall over chunks, and recall by date."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from loreweave.functions import dates
from loreweave.functions.stem import Wanted, asked_tokens, stem, tokens_of
from loreweave.functions.text import event_terms, graph_terms, overlap, words_of
from loreweave.sources.shared import cut

# The usual BM25 parameters and the least idf.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Terms of queries that are looked for in every chunk at once; more are searched block by block.
MOST_TERMS = 50_000
#: Distinct query tokens that are sent to every task that counts them; with more, all tokens are counted.
MOST_TOKENS = 100_000
#: Words of queries that are sent to every task at once; more are searched block by block.
MOST_ASKED = 50_000
#: Dated memories that are sent to every task; with more, terms of texts go to them.
MOST_DATED = 2_000_000
#: Pairs of a query and one of its terms that a worker goes through at once.
MOST_PAIRS = 1 << 20
#: Bytes of texts that a worker goes through at once.
SLICE = 1 << 20
#: Words whose stems a worker remembers.
MOST_WORDS = 200_000


def query_tokens(queries: DataFrame, stemming: bool = True) -> DataFrame:
    """(query_id, token), each once: the stems of the words of the queries. A query without words has none."""

    def run(batches):
        for batch in batches:
            at, found = [], []
            for i, query in enumerate(batch.column("query").to_pylist()):
                words = {stem(x) if stemming else x: None for x in asked_tokens(query)}
                at += [i] * len(words)
                found += words
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], ["query_id", "token"])

    rows = queries.select("query_id", "query")
    return rows.mapInArrow(run, f"query_id {rows.schema['query_id'].dataType.simpleString()}, token string").distinct()


def index(memories: DataFrame, asked: DataFrame, stemming: bool = True) -> DataFrame:
    """(memory_id, length, hits): the tokens of project, session, summary and tags, and how often those of `asked` (token) occur.

    One row per memory, written once: texts are tokenised in one pass, whatever the number of queries that use it.
    """
    known = [r[0] for r in asked.select("token").distinct().limit(MOST_TOKENS + 1).collect()]
    return cut(counted(memory_texts(memories), frozenset(known) if len(known) <= MOST_TOKENS else None, stemming), "index")


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some `most` bytes of a text column, one row at least, so that a worker holds the objects of one slice."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum(dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def memory_texts(memories: DataFrame) -> DataFrame:
    """(memory_id, text): what full text finds a memory by."""
    return memories.select("memory_id", F.concat_ws(" ", "project", "session_id", "summary", "tags").alias("text"))


def counted(texts: DataFrame, wanted: frozenset | None, stemming: bool = True) -> DataFrame:
    """(memory_id, length, hits) of texts (memory_id, text): the number of tokens, and how often those wanted, or all, occur.

    What is done word by word is done once for each distinct word of a slice; tokens are split and counted as arrays.
    """
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        wanted, stems = shared.value, {}
        may_have = Wanted(wanted).may_have if wanted is not None and stemming else lambda word: True
        for batch in sliced(batches, "text"):
            at, number, words = tokens_of(batch.column("text"))
            found = list(map(stems.get, words))  # stems, or nothing of words that aren't wanted
            for i in [i for i, x in enumerate(found) if x is None]:
                x = stem(words[i]) if stemming and may_have(words[i]) else words[i]
                found[i] = x = x if wanted is None or x in wanted else ""
                if len(stems) < MOST_WORDS:
                    stems[words[i]] = x
            names = {x: i for i, x in enumerate(dict.fromkeys(found))}
            code = np.array([names[x] for x in found], np.int64)[number]
            pairs, counts = np.unique((at * len(names) + code)[code != names.get("", -1)], return_counts=True)
            row, name = np.divmod(pairs, max(len(names), 1))
            hits = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(name)), pa.array(counts, pa.int32())], ["token", "tf"])
            starts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lengths = np.bincount(at, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("memory_id"), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), hits)], ["memory_id", "length", "hits"])

    kind = texts.schema["memory_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"memory_id {kind}, length int, hits array<struct<token:string,tf:int>>")


def postings(ready: DataFrame) -> DataFrame:
    """(memory_id, length, token, tf) of an index."""
    return ready.select("memory_id", "length", F.inline("hits"))


def bm25(memories: DataFrame, queries: DataFrame, stemming: bool = True, ready: DataFrame | None = None) -> DataFrame:
    """(query_id, memory_id, score) of memories with at least one query word. Corpus counts are of all memories.

    ready: an index of the memories that has the tokens of these queries.
    """
    asked = query_tokens(queries, stemming)
    ready = index(memories, asked, stemming) if ready is None else ready
    total = ready.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    found = postings(ready)
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    n, f = F.col("n_docs"), F.col("df")
    idf = df.crossJoin(F.broadcast(total)).select("token", F.greatest(F.log((n - f + 0.5) / (f + 0.5)), F.lit(LEAST_IDF)).alias("idf"), "avg_length")  # one row of totals
    weighed = asked.join(idf, "token")
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return found.join(weighed, "token").groupBy("query_id", "memory_id").agg(F.sum(part).alias("score"))


def top(rows: DataFrame, k: int, *order, by: str = "query_id") -> DataFrame:
    """The first k rows of each query, with rank0 from 0.

    The bound is on the row number itself, so that each task keeps k rows of a query before they are shuffled.
    """
    w = Window.partitionBy(by).orderBy(*order)
    first = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return first.withColumn("rank0", F.col("_n").cast("long") - 1).drop("_n")


def in_blocks(queries: DataFrame, size: int, search: Callable[[list[Row]], DataFrame]) -> DataFrame:
    """What search gives for all rows of queries (query_id and more), some `size` at a time; rows of one id stay together.

    With more than one block, what a block finds is written before the next is searched, so one block is held at a time.
    """
    block = queries.limit(size + 1).collect()
    if len(block) <= size:
        return search(block)
    block, parts = [], []
    for row in queries.orderBy("query_id").toLocalIterator():
        if len(block) >= size and row["query_id"] != block[-1]["query_id"]:
            parts.append(cut(search(block), "block"))
            block = []
        block.append(row)
    return reduce(DataFrame.unionByName, [*parts, cut(search(block), "block")])


def _weights(batch: pa.RecordBatch, tokens: pa.Array, idf: np.ndarray, average: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of an index, by token: where the rows of each token begin, the rows, and what the token adds to their scores."""
    hits = batch.column("hits")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
    flat = hits.flatten()
    number = pc.index_in(flat.field("token"), tokens).fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    order = order[np.searchsorted(number[order], 0) :]
    number, rows = number[order], rows[order]
    tf = flat.field("tf").to_numpy(zero_copy_only=False)[order].astype(float)
    length = batch.column("length").to_numpy(zero_copy_only=False)[rows].astype(float)
    return np.searchsorted(number, np.arange(len(tokens) + 1)), rows, idf[number] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _best(score: np.ndarray, created: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of all scores that may be among the k best, of those with one score only the k newest, largest ids first."""
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-8)  # scores are compared after rounding
        order = np.lexsort((-ids[at], -created[at], -score[at]))
        at = at[order]
        new = np.flatnonzero(np.concatenate(([True], score[at][1:] != score[at][:-1])))
        at = at[np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at)))) < k]
    return at


def _top_hits(seen: DataFrame, ready: DataFrame, asked: DataFrame, k: int, by_score: bool) -> DataFrame:
    """(query_id, memory_id, score, created_at) of the k best hits of each batch of seen, an index with created_at (both numbers: ids, times).

    Queries (query_id, token) go to every task, MOST_ASKED rows at a time. What is then shuffled is some k rows of a query and
    batch, not each memory with a word of the query. Counts of the corpus are those of `ready`, with all memories.
    """
    n, average = ready.agg(F.count("*"), F.avg("length")).first()
    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((asked, "query_id"), (seen, "memory_id"), (seen, "created_at"))]

    def search(rows: list[Row]) -> DataFrame:
        words = seen.sparkSession.createDataFrame([(x,) for x in {r["token"] for r in rows}], "token string")
        df = {r[0]: r[1] for r in postings(ready).join(F.broadcast(words), "token").groupBy("token").agg(F.count("*")).collect()}  # at most MOST_ASKED
        tokens = sorted(df)
        place = {x: i for i, x in enumerate(tokens)}
        queries: dict = {}
        for r in rows:
            if r["token"] in place:
                queries.setdefault(r["query_id"], []).append(place[r["token"]])
        f = np.array([df[x] for x in tokens], float)
        idf = np.maximum(np.log((n - f + 0.5) / (f + 0.5)), LEAST_IDF)
        shared = seen.sparkSession.sparkContext.broadcast((tokens, idf, [(q, sorted(x)) for q, x in queries.items()]))

        def run(batches):
            tokens, idf, queries = shared.value
            tokens = pa.array(tokens, pa.string())
            for batch in batches:
                starts, rows, weights = _weights(batch, tokens, idf, average)
                created, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("created_at", "memory_id"))
                names, places, scores = [], [], []
                for q, words in queries:
                    spans = [slice(starts[w], starts[w + 1]) for w in words]
                    score = np.bincount(np.concatenate([rows[x] for x in spans]), np.concatenate([weights[x] for x in spans]), batch.num_rows)
                    hit = np.flatnonzero(score)
                    if not by_score:
                        score = np.zeros(batch.num_rows)
                    at = hit[_best(score[hit], created[hit], ids[hit], k)]
                    names.append(np.full(len(at), q))
                    places.append(at)
                    scores.append(score[at])
                if names:
                    at = pa.array(np.concatenate(places))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), batch.column("memory_id").take(at), pa.array(np.concatenate(scores), pa.float64()), batch.column("created_at").take(at)], ["query_id", "memory_id", "score", "created_at"])

        return seen.select("memory_id", "length", "hits", "created_at").mapInArrow(run, f"{kinds[0]}, {kinds[1]}, score double, {kinds[2]}")

    return in_blocks(asked, MOST_ASKED, search)


def search_project(visible: DataFrame, memories: DataFrame, queries: DataFrame, k: int, project: str | None = None, ready: DataFrame | None = None) -> DataFrame:
    """BM25 hits among visible memories: best score, newest, largest id first. ready: as in bm25."""
    asked = cut(query_tokens(queries), "asked")
    if ready is None:  # questions without words, or none, find nothing, so no text is gone through for them
        ready = index(memories.limit(0) if asked.isEmpty() else memories, asked)
    visible = visible if project is None else visible.where(F.col("project") == project)
    hits = _top_hits(ready.join(visible.select("memory_id", "created_at"), "memory_id"), ready, asked, k, True)
    return top(hits, k, F.desc(F.round("score", 9)), F.desc("created_at"), F.desc("memory_id"))


def search_everywhere(visible: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Memories with any query word, the newest first."""
    asked = cut(query_tokens(queries), "asked")
    ready = index(visible, asked)
    hits = _top_hits(ready.join(visible.select("memory_id", "created_at"), "memory_id"), ready, asked, k, False).drop("score")
    return top(hits, k, F.desc("created_at"), F.desc("memory_id"))


def match_all(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, memory_id) of memories that have every word of the query."""
    asked = query_tokens(queries)
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = postings(index(memories, asked)).join(asked, "token").groupBy("query_id", "memory_id").agg(F.count("*").alias("n"))
    return hits.join(need, "query_id").where("n = need").select("query_id", "memory_id")


class Held:
    """Which of some terms a text holds as substrings. Terms may have no ASCII characters but letters, digits and apostrophes.

    Terms are kept by how they begin, so a word is compared with those alone that begin as it does at one of its places.
    """

    def __init__(self, terms):
        terms = set(terms)
        self.n = min(3, min(map(len, terms), default=1))
        self.by: dict[str, list[str]] = {}
        for x in sorted(terms):
            self.by.setdefault(x[: self.n], []).append(x)
        self.apart = bytes(c if c >= 128 or c == 39 or chr(c).isalnum() else 32 for c in range(256))
        self.known: dict[str, tuple[str, ...]] = {}

    def of(self, text: str) -> list[str]:
        found: set[str] = set()
        for word in set(text.encode("utf-8", "surrogatepass").translate(self.apart).decode("utf-8", "surrogatepass").split(" ")):
            held = self.known.get(word)
            if held is None:
                held = tuple(x for i in range(len(word) - self.n + 1) for x in self.by.get(word[i : i + self.n], ()) if word.startswith(x, i))
                if len(self.known) < MOST_WORDS and len(word) <= 64:
                    self.known[word] = held
            found.update(held)
        return sorted(found)


def chunk_parents(chunks: DataFrame, visible: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Memories by the most query terms (of the first eight) that one of their chunks holds. Any number of queries.

    A term has no ASCII characters but letters, digits and apostrophes, so it is found in the words between others; each distinct
    word of a text is gone through once, whatever the number of terms, MOST_TERMS of which are sent to every task at a time.
    Texts stay where they are: what is shuffled is (memory_id, created_at, h, term).
    """
    asked = queries.select("query_id", F.explode(F.slice(event_terms(F.col("query")), 1, 8)).alias("term"))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    rows = chunks.select("memory_id", "created_at", F.xxhash64(text).alias("h"), text.alias("t"))

    def held(terms: list[Row]) -> DataFrame:
        shared = chunks.sparkSession.sparkContext.broadcast(Held(r["query_id"] for r in terms))

        def run(batches):
            for batch in sliced(batches, "t"):
                found = [shared.value.of(t) for t in batch.column("t").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("memory_id", "created_at", "h")), pa.array([x for f in found for x in f], pa.string())], ["memory_id", "created_at", "h", "term"])

        kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("memory_id", "created_at", "h")]
        return rows.mapInArrow(run, ", ".join([*kinds, "term string"]))

    found = in_blocks(asked.select(F.col("term").alias("query_id")).distinct(), MOST_TERMS, held).join(visible.select("memory_id"), "memory_id")
    #: Chunks of a memory with one text count once, so a term is counted once for each text.
    hits = found.join(asked, "term").groupBy("query_id", "memory_id", "h").agg(F.count_distinct("term").alias("score"), F.max("created_at").alias("created_at"))
    hits = hits.groupBy("query_id", "memory_id").agg(F.max("score").cast("int").alias("score"), F.max("created_at").alias("created_at"))
    return top(hits, k, F.desc("score"), F.desc("created_at"), F.desc("memory_id"))


def by_year(memories: DataFrame, meta: DataFrame, years: DataFrame, k: int) -> DataFrame:
    """(query_id, memory_id, rank0) of memories whose event time names a year (query_id, year), the newest first."""
    found = memories.select("memory_id", "created_at").join(meta.where("event_time IS NOT NULL").select("memory_id", "event_time"), "memory_id")
    named = found.withColumn("year", F.explode(F.array_distinct(F.regexp_extract_all("event_time", F.lit("([0-9]{4})"), 1))))
    hits = named.join(years, "year").select("query_id", "memory_id", "created_at").distinct()
    return top(hits, k, F.desc("created_at"), F.desc("memory_id"))


def temporal_events(memories: DataFrame, meta: DataFrame, queries: DataFrame, k: int, pool: int | None = None) -> DataFrame:
    """Dated memories by shared terms, kind, source and closeness in time; where dates disagree, evidence counts more.

    All dated memories are looked at; with a pool, only the newest so many of them. Texts stay where they are: what is known of
    the dated ones, if they are MOST_DATED at most, goes to them, and else the terms of texts that are asked for go to it. What is
    then shuffled is some 2 * k rows of a query and batch.
    """
    dated = meta.select("memory_id", "event_time", "kind").where("trim(event_time) <> ''")
    if pool is not None:
        dated = memories.select("memory_id", "created_at").join(dated, "memory_id").orderBy(F.desc("created_at"), F.desc("memory_id")).limit(max(pool, k)).drop("created_at")
    exact = F.when(F.length(F.regexp_replace("event_time", "[^0-9]", "")) >= 8, 1.0).otherwise(0.0)
    kind = F.when(F.col("kind") == "fact", 4.0).otherwise(1.0)
    dated = cut(dated.select("memory_id", kind.alias("kind"), exact.alias("exact"), dates.event_date(F.col("event_time")).alias("day")), "dated")
    few = dated.count() <= MOST_DATED
    asked = cut(queries.select("query_id", event_terms(F.col("query")).alias("ts"), dates.query_anchor(F.col("query")).alias("anchor")).where(F.size("ts") > 0), "asked")

    def search(rows: list[Row]) -> DataFrame:
        words = sorted({r["term"] for r in rows})
        text = F.concat_ws(" ", "summary", "tags")
        told = F.when(F.coalesce(F.col("text").contains("source:"), F.lit(False)), 2.0).otherwise(0.0).alias("source")
        #: Where few terms are left of a text, no filter is set: it would be moved to all memories, and take their terms once more.
        held = F.filter(event_terms(F.col("text")), lambda x: x.isin(words)).alias("terms")
        texts = memories.select("memory_id", "created_at", text.alias("text"))
        if few:
            found = texts.join(F.broadcast(dated), "memory_id").select("memory_id", "created_at", "kind", "exact", "day", told, held)
        else:
            found = cut(texts.select("memory_id", "created_at", told, held), "held").join(dated, "memory_id")
        return _likely_events(found, rows, words, k)

    hits = cut(in_blocks(asked.select("query_id", F.explode("ts").alias("term"), F.size("ts").alias("size"), "anchor.*"), MOST_ASKED, search), "events")
    rows = hits.join(asked, "query_id")
    part, n = F.col("n") / F.size("ts"), F.col("n")
    rows = rows.withColumn("quality", n * 2.0 + part * 2.0 + F.col("kind") + F.col("source")).withColumn("score", n * 10.0 + part * 3.0 + F.col("kind") + F.col("source") + F.col("exact") + dates.proximity(F.col("anchor"), F.col("day")))
    days = F.size(F.collect_set("day").over(Window.partitionBy("query_id")))
    rows = rows.withColumn("score", F.col("score") + F.when(days > 1, F.col("quality") * 2.0).otherwise(0.0))
    return top(rows.select("query_id", "memory_id", "score", "quality", "created_at"), k, F.desc(F.round("score", 9)), F.desc(F.round("quality", 9)), F.desc("created_at"), "memory_id")


def _likely_events(found: DataFrame, rows: list[Row], words: list[str], k: int) -> DataFrame:
    """(query_id, memory_id, created_at, kind, exact, day, source, n) of what may be among the k best of temporal_events.

    Of each batch of dated memories with the terms they have of `words`, and each query (rows of query_id, term, size, date,
    precision): the k best, whether dates disagree or not, and the first and the last day, so that it can be told if they do.
    """
    place = {x: i for i, x in enumerate(words)}
    ids = list(dict.fromkeys(r["query_id"] for r in rows))
    number = {x: i for i, x in enumerate(ids)}
    uses = np.array(sorted((place[r["term"]], number[r["query_id"]]) for r in rows), np.int64).reshape(-1, 2)
    by_id = {r["query_id"]: r for r in rows}
    size = np.array([by_id[x]["size"] for x in ids], float)
    date = np.array([by_id[x]["date"] for x in ids], "datetime64[D]")
    precision = np.array([by_id[x]["precision"] or "" for x in ids])
    shared = found.sparkSession.sparkContext.broadcast((words, np.searchsorted(uses[:, 0], np.arange(len(words) + 1)), uses[:, 1], ids, size, date, precision))
    columns = ("memory_id", "created_at", "kind", "exact", "day", "source")

    def run(batches):
        words, starts, queries, ids, size, date, precision = shared.value
        words = pa.array(words, pa.string())

        def parts(batch):
            """The batch in slices with some MOST_PAIRS pairs of a query and one of its terms, one row at least."""
            terms = batch.column("terms")
            term = pc.index_in(terms.flatten(), words).to_numpy(zero_copy_only=False)
            pairs = np.append(0, np.cumsum(starts[term + 1] - starts[term]))[np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False), dtype=np.int64))]
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(pairs, pairs[at] + MOST_PAIRS, "right")) - 1)
                yield batch.slice(at, end - at)
                at = end

        for batch in (x for batch in batches for x in parts(batch)):
            memory, created, kind, exact, source = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("memory_id", "created_at", "kind", "exact", "source"))
            day = batch.column("day").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            terms = batch.column("terms")
            at = np.repeat(np.arange(batch.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            term = pc.index_in(terms.flatten(), words).to_numpy(zero_copy_only=False)
            counts = starts[term + 1] - starts[term]
            asked = queries[np.repeat(starts[term] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            pairs, n = np.unique(asked * batch.num_rows + np.repeat(at, counts), return_counts=True)
            q, r = np.divmod(pairs, batch.num_rows)
            part, near = n / size[q], _proximity(date[q], precision[q], day[r])
            quality = n * 2.0 + part * 2.0 + kind[r] + source[r]
            score = n * 10.0 + part * 3.0 + kind[r] + source[r] + exact[r] + near
            ends = np.searchsorted(q, np.arange(len(ids) + 1))
            has = np.flatnonzero(~np.isnat(day[r]))
            by_day = has[np.lexsort((day[r[has]], q[has]))]
            new = np.flatnonzero(np.diff(q[by_day], prepend=-1))
            kept = [by_day[new], by_day[np.append(new[1:], len(by_day)) - 1] if len(new) else new]
            for x in (score, score + quality * 2.0):
                order = np.lexsort((memory[r], -created[r], -quality, -x, q))
                worst = x[order[np.minimum(ends[:-1] + k, ends[1:])[q] - 1]] - 1e-8  # scores are compared after rounding
                new = np.flatnonzero((np.diff(q[order], prepend=-1) != 0) | (np.diff(x[order], prepend=0) != 0) | (np.diff(quality[order], prepend=0) != 0))
                same = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
                kept.append(order[(x[order] >= worst) & (same < k)])
            kept = np.unique(np.concatenate(kept))
            rows = pa.array(r[kept])
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q[kept]], pa.int64()), *(batch.column(c).take(rows) for c in columns), pa.array(n[kept], pa.int64())], ["query_id", *columns, "n"])

    kinds = [f"{c} {found.schema[c].dataType.simpleString()}" for c in columns]
    return found.select(*columns, "terms").mapInArrow(run, ", ".join(["query_id long", *kinds, "n long"]))


def _proximity(date: np.ndarray, precision: np.ndarray, day: np.ndarray) -> np.ndarray:
    """dates.proximity of arrays of days."""
    (a, b), out = (x.astype("datetime64[M]").astype(np.int64) for x in (date, day)), np.zeros(len(day))
    years, months = np.abs(a // 12 - b // 12), np.abs(a % 12 - b % 12)
    for name, near in (("day", 8.0 - np.abs((date - day).astype(np.int64)) / 7.0), ("month", 6.0 - (years * 12 + months)), ("year", 4.0 - years)):
        out = np.where(precision == name, near, out)
    return np.where(np.isnat(date) | np.isnat(day), 0.0, np.maximum(out, 0.0))


def covered_share(query: Column, text: Column) -> Column:
    """Share of the query's terms that a text holds as substrings; a query without terms asks nothing."""
    terms = event_terms(query)
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda x: F.contains(F.lower(text), x))) / F.size(terms))


def entity_tokens(memories: DataFrame) -> DataFrame:
    """(memory_id, entity): the lower-case words of three or more characters of summary and tags, each once per memory."""
    words = F.filter(F.transform(words_of(F.concat_ws(" ", "summary", "tags")), F.lower), lambda x: F.length(x) >= 3)
    return memories.select("memory_id", F.explode(F.array_distinct(words)).alias("entity"))


def by_entity(entities: DataFrame, memories: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, memory_id, rank0) of memories with just an entity (query_id, entity) of three or more characters, the newest first."""
    named = asked.select("query_id", F.lower(F.trim("entity")).alias("entity")).where("length(entity) >= 3").distinct()
    hits = entities.join(named, "entity").select("query_id", "memory_id").distinct().join(memories.select("memory_id", "created_at"), "memory_id")
    return top(hits, k, F.desc("created_at"), F.desc("memory_id"))


# What marks a memory as linked to its source, or as made from others.
LINKED_TAGS, LINKED_TEXT = ("locomo", "source", "fact"), "(as of "
DERIVED = ("synthesized", "derived")


def of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of memories that found (memory_id) has. Where found was written and is small, it goes to the rows, which aren't shuffled."""
    return rows.join(found.select("memory_id").distinct(), "memory_id", "left_semi")


def source_facts(found: DataFrame, queries: DataFrame, memories: DataFrame, meta: DataFrame) -> DataFrame:
    """Lexical hits (query_id, memory_id, rank0) that are facts or linked to a source and not derived, with n_shared and n_terms.

    n_shared: terms of the query that summary and tags have.
    """
    rows = found.select("query_id", "memory_id", "rank0").join(queries.select("query_id", event_terms(F.col("query")).alias("ts")).where(F.size("ts") > 0), "query_id")
    rows = rows.join(of(memories, found).select("memory_id", "summary", F.coalesce("tags", F.lit("")).alias("tags")), "memory_id").join(meta.select("memory_id", "kind"), "memory_id", "left")
    any_in = lambda c, parts: reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])
    linked = any_in(F.lower("tags"), LINKED_TAGS) | F.contains("summary", F.lit(LINKED_TEXT))
    kind = F.coalesce("kind", F.lit(""))
    rows = rows.where((kind != "inference") & ((kind == "fact") | linked) & ~any_in(F.lower(F.concat_ws(" ", "summary", "tags")), DERIVED))
    return rows.select("query_id", "memory_id", "rank0", overlap(F.col("ts"), graph_terms(F.concat_ws(" ", "summary", "tags"))).alias("n_shared"), F.size("ts").alias("n_terms"))


def overlap_of(query: Column, text: Column) -> Column:
    """Share of the query's terms that a text has."""
    terms = event_terms(query)
    return F.when(F.size(terms) == 0, 0.0).otherwise(overlap(terms, event_terms(text)) / F.size(terms))
