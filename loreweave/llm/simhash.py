"""SimHash near-duplicates: pigeonhole blocks find candidates, the Hamming distance decides, components group them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_place, cut, parallelism, pick, release
from loreweave.operators.components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Widths of the blocks of a fingerprint. Two fingerprints within DISTANCE bits differ in at most as many blocks, so they
#: agree on the others: every set of len(BLOCKS) - DISTANCE blocks is one key. 35 keys of 27 or 28 bits.
BLOCKS = (10, 9, 9, 9, 9, 9, 9)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included; no words: 0."""
    if not text:
        return 0
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= SHINGLE:
        return digest(b" ".join(found), SEED)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: -SHINGLE])).tolist()
    n = len(starts)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    release()
    for batch in batches:
        values = np.fromiter((fingerprint(x) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def block_keys(fp="fp"):
    """One long for each set of blocks: the set's number, then the blocks' bits."""
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    keys = []
    for k, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << BLOCKS[i]) - 1).cast("long")))
        keys.append(key)
    return keys


def _forest(fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within one block: from each component's smallest member to the others.

    A breadth-first search compares only with members not yet reached, so a dense group costs little more than its size.
    """
    left = np.arange(len(fp))
    out = []
    while len(left):
        front, left = [left[0]], left[1:]
        part = [front[0]]
        while front and len(left):
            near = np.bitwise_count(fp[left] ^ fp[front.pop()]) <= DISTANCE
            if near.any():
                new = left[near].tolist()
                part += new
                front += new
                left = left[~near]
        if len(part) > 1:
            ids = rep[np.array(part)]
            low = int(ids.min())
            out += [(int(x), low) for x in ids if x != low]
    return out


def _links(batches):
    """Links from rows sorted by key; rows of a key that may go on in the next batch are carried over."""
    rest = None
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(key, fp, rep):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        a, b = [], []
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE]
        a.append(np.maximum(rep[two], rep[two + 1]))
        b.append(np.minimum(rep[two], rep[two + 1]))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if found := _forest(fp[s : s + n], rep[s : s + n]):
                x = np.array(found, np.int64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")]
        now[1] = now[1].view(np.uint64)
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1]))
        rest = [x[last:] for x in now]
        if last:
            yield linked(*[x[:last] for x in now])
    if rest is not None:
        yield linked(*rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long bits) and component_id, one row per row of docs (doc_id long, text).

    Fingerprints at DISTANCE or fewer differing bits link; component_id is the smallest doc_id reachable, itself included.
    Equal fingerprints are one node, so copies cost nothing. Null and empty texts have fingerprint 0 and link like others;
    rows with one id twice are rows of one node each; rows with a null id link nothing and get the component of their
    fingerprint, null if there is none. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = cut(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")), "nodes")
    keyed = nodes.select("fp", "rep", F.explode(F.array(*block_keys())).alias("key"))
    links = keyed.repartition(parallelism(spark), "key").sortWithinPartitions("key", "rep").mapInArrow(_links, "a long, b long")
    #: An id on several rows joins their fingerprints.
    same = rows.where("doc_id is not null").join(nodes.select("fp", "rep"), "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("fp").alias("n")).where("n > 1").select(F.col("doc_id").alias("a"))
    links = links.unionByName(same.join(twice, "a", "left_semi"))
    found = components(links)
    of = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those whose component has a smaller doc_id; all columns stay. Rows without an id stay."""
    names = docs.columns
    gone = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return by_place(docs, "doc_id").join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti").toDF(*names)
