"""Content types, and a store that keeps each content once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators.search import SLICE, sliced

# Extensions of source files, and what a log line begins with or holds.
CODE_EXTENSIONS = (
    "rs ts tsx js jsx py go c h cpp hpp java rb kt swift php cs sh bash zsh fish lua r jl ex exs erl hs ml mli clj cljs scala groovy dart vim tf toml yaml yml"
).split()
LOG_LINE = r"^[0-9]{4}-|[ ](INFO|WARN|ERROR|DEBUG|TRACE)[ \t]|\[(INFO|WARN|ERROR|DEBUG|TRACE)\]"
DIFF_START = r"^(@@ |--- |\+\+\+ |diff )"


def content_type(text: Column, extension: Column | None = None) -> Column:
    """binary, json, diff, log, code or text, in this order."""
    # The lines are a variable: an expression would split the text again for each rule.
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")

    def by_lines(ls: Column) -> Column:
        n = F.size(ls)
        hits = lambda p: F.size(F.filter(ls, lambda x: x.rlike(p)))
        first = F.regexp_replace(F.coalesce(F.get(ls, F.lit(0)), F.lit("")), r"^\s+", "")
        diff = first.rlike(DIFF_START) | ((hits("^@@") > 0) & (hits("^[-+@]") >= 3) & (hits("^[-+@]") * 10 >= n * 6))
        log = (n >= 2) & (hits(LOG_LINE) * 2 >= n)
        return F.when(diff, "diff").when(log, "log").when(code, "code").otherwise("text")

    dense = F.length(text) - F.length(F.translate(text, "{}();", ""))
    code = (F.length(text) > 0) & (dense / F.length(text) > 0.02)
    if extension is not None:
        code = code | F.coalesce(F.lower(extension).isin(*CODE_EXTENSIONS), F.lit(False))
    json = F.trim(text).rlike(r"^[\[{]") & F.try_parse_json(F.trim(text)).isNotNull()
    return F.when(text.contains("\x00"), "binary").when(json, "json").otherwise(F.get(F.transform(F.array(lines), by_lines), F.lit(0)))


def store(rows: DataFrame, text: str = "text") -> DataFrame:
    """Each content once, by its hash, with how often it was stored."""
    return rows.groupBy(F.sha2(text, 256).alias("hash")).agg(F.max(F.octet_length(text)).cast("long").alias("orig_len"), F.count("*").alias("refcount"), F.first(text).alias("data"))


def compressed(rows: DataFrame) -> DataFrame:
    """(hash, data) of contents (hash, data: text): each compressed by itself, in slices of some bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=19)
        for batch in sliced(batches, "data"):
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array([c.compress((x or "").encode()) for x in batch.column("data").to_pylist()], pa.binary())], ["hash", "data"])

    return rows.select("hash", "data").mapInArrow(run, "hash string, data binary")


def load(blobs: DataFrame) -> DataFrame:
    """Contents of compressed blobs (hash, data), and whether they still have their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for batch in sliced(batches, "data", SLICE // 8):
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array([None if x is None else d.decompress(x).decode() for x in batch.column("data").to_pylist()], pa.string())], ["hash", "text"])

    return blobs.select("hash", "data").mapInArrow(run, "hash string, text string").withColumn("intact", F.sha2("text", 256) == F.col("hash"))


def stats(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count("*").alias("n_blobs"), F.sum("orig_len").alias("stored_bytes"), F.sum(F.col("orig_len") * F.col("refcount")).alias("referenced_bytes")).withColumn(
        "saved_ratio", F.round(1 - F.try_divide(F.col("stored_bytes").cast("double"), F.col("referenced_bytes").cast("double")), 6)
    )


def release(blobs: DataFrame, released: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, collected) after released references (hash, n) are taken off; counts end at 0."""
    left = blobs.join(released, "hash", "left").withColumn("refcount", F.greatest(F.col("refcount") - F.coalesce("n", F.lit(0)), F.lit(0))).drop("n")
    return left.where("refcount > 0"), left.where("refcount <= 0")


#: A dictionary needs so many samples, is trained on so many of the newest at most, and has so many bytes.
LEAST_SAMPLES, MOST_SAMPLES, DICTIONARY_BYTES = 32, 256, 16 << 10


def train_dictionaries(samples: DataFrame) -> DataFrame:
    """(content_type, hash, data): a compression dictionary for each type with enough samples (content_type, data, order)."""
    import hashlib

    w = Window.partitionBy("content_type").orderBy(F.desc("order"))
    some = samples.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= MOST_SAMPLES)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        rows = []
        if len(pdf) >= LEAST_SAMPLES:
            try:
                d = zstandard.train_dictionary(DICTIONARY_BYTES, [x.encode() for x in pdf["data"]]).as_bytes()
                rows.append((pdf["content_type"].iloc[0], hashlib.sha256(d).hexdigest(), d))
            except zstandard.ZstdError:  # the samples have too little in common
                pass
        return pd.DataFrame(rows, columns=["content_type", "hash", "data"])

    return some.select("content_type", "data").groupBy("content_type").applyInPandas(train, "content_type string, hash string, data binary")


def registered(known: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Dictionaries (content_type, hash, data, trained_at) with those of new (content_type, hash, data) that aren't known yet."""
    fresh = new.join(known.select("hash"), "hash", "left_anti").withColumn("trained_at", F.lit(now).cast("long"))
    return known.unionByName(fresh.select(*known.columns))


def pack(texts: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """texts (hash, content_type, data) as (hash, content_type, packed, dictionary, plain): compressed with the newest dictionary of
    the type, if that is smaller than without one. dictionary is its hash, or null; plain is the bytes of the text without one.

    dictionaries: content_type, hash, data, trained_at; each has DICTIONARY_BYTES at most and a type has one newest.
    """
    newest = dictionaries.groupBy("content_type").agg(F.max_by(F.struct("hash", "data"), F.struct("trained_at", "hash")).alias("d")).select("content_type", "d.hash", "d.data")
    by_type = {r.content_type: (r.hash, bytes(r.data)) for r in newest.collect()}  # one a content type
    shared = texts.sparkSession.sparkContext.broadcast(by_type)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        plain = zstandard.ZstdCompressor(level=19)
        own = {k: (h, zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(d))) for k, (h, d) in shared.value.items()}
        for pdf in batches:
            packed, used, sizes = [], [], []
            for kind, text in zip(pdf["content_type"], pdf["data"], strict=True):
                raw = (text or "").encode()
                best, by = plain.compress(raw), None
                sizes.append(len(best))
                if kind in own and len(shorter := own[kind][1].compress(raw)) < len(best):
                    best, by = shorter, own[kind][0]
                packed.append(best)
                used.append(by)
            yield pd.DataFrame({"hash": pdf["hash"], "content_type": pdf["content_type"], "packed": packed, "dictionary": used, "plain": sizes})

    return texts.select("hash", "content_type", "data").mapInPandas(run, "hash string, content_type string, packed binary, dictionary string, plain int")


def unpack(packed: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """Contents of packed blobs (hash, packed, dictionary), and whether they still have their hash; old dictionaries serve as well."""
    by_hash = {r.hash: bytes(r.data) for r in dictionaries.join(packed.select(F.col("dictionary").alias("hash")).distinct(), "hash", "left_semi").select("hash", "data").distinct().collect()}  # trained, so few
    shared = packed.sparkSession.sparkContext.broadcast(by_hash)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        own = {h: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)) for h, d in shared.value.items()}
        for pdf in batches:
            texts = [(own[h] if h else plain).decompress(b).decode() for b, h in zip(pdf["packed"], pdf["dictionary"].where(pdf["dictionary"].notna(), None), strict=True)]
            yield pd.DataFrame({"hash": pdf["hash"], "text": texts})

    return packed.select("hash", "packed", "dictionary").mapInPandas(run, "hash string, text string").withColumn("intact", F.sha2("text", 256) == F.col("hash"))


def compressed_sizes(texts: pd.Series, dictionary: bytes | None) -> list[int]:
    """Bytes of each text compressed, with a dictionary only where that is smaller."""
    import zstandard

    plain = zstandard.ZstdCompressor(level=19)
    own = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else plain
    return [min(len(plain.compress(t.encode())), len(own.compress(t.encode()))) for t in texts]
