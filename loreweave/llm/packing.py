"""Packing of token ids into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loreweave.llm.common import pick
from loreweave.llm.tokens import encoder

CAPACITY = 2048
END_ID = 1
#: A document's last part is cut into pieces of at most so many ids; small pieces balance well.
PIECE = 512
#: Documents that are packed together. Groups are independent, so a lost task is simply run again.
GROUP = 1024


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indexes of sizes in k windows of near-equal sums.

    The sizes in descending order, k at a time, are the first partial partitions. The two of the largest imbalance merge, the
    fullest windows of one with the emptiest of the other, until one is left.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heap = []
    for n, at in enumerate(range(0, len(order), k)):
        some = order[at : at + k]
        sums = np.zeros(k, np.int64)
        sums[: len(some)] = [sizes[i] for i in some]
        sums -= sums[-1]
        heap.append((-int(sums[0]), n, sums, [*[[i] for i in some], *[[] for _ in range(k - len(some))]]))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, xs = heapq.heappop(heap)
        _, _, b, ys = heapq.heappop(heap)
        sums = a + b[::-1]
        rank = np.argsort(-sums, kind="stable")
        sums = sums[rank]
        sums -= sums[-1]
        joined = [x + y for x, y in zip(xs, reversed(ys), strict=True)]
        heapq.heappush(heap, (-int(sums[0]), n, sums, [joined[i] for i in rank.tolist()]))
        n += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; their number rises whenever one is over it. No sizes: no windows."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        out = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return [w for w in out if w]
        k += max(1, k // 200)


def pieces_of(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole windows, then even parts of at most `piece`."""
    full = n // capacity * capacity
    out = [(a, capacity) for a in range(0, full, capacity)]
    parts = -(-(n - full) // piece)
    for p in range(parts):
        a, b = full + (n - full) * p // parts, full + (n - full) * (p + 1) // parts
        out.append((a, b - a))
    return out


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) for documents of these lengths."""
    out, free = [], []
    window = 0
    for d, n in enumerate(lengths):
        for start, length in pieces_of(n, capacity):
            if length == capacity:
                out.append((d, start, length, window, 0))
                window += 1
            else:
                free.append((d, start, length))
    for members in windows([x[2] for x in free], capacity):
        offset = 0
        for i in members:
            d, start, length = free[i]
            out.append((d, start, length, window, offset))
            offset += length
        window += 1
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, ordinary: bool = False) -> DataFrame:
    """One row per piece of docs (doc_id, text): its ids (little-endian unsigned 32 bits) and its place in a sequence.

    A document is the ids of its whole text and end_id; null and empty texts are end_id alone. Rows are documents each, also
    with a repeated or null id. Sequences are filled within a partition, so nothing is shuffled; an empty table gives none.
    tokenizer: a file that every executor can read. ordinary: strings of special tokens are ordinary text, not their ids.
    """

    def run(batches):
        ids_of = encoder(tokenizer, True, ordinary).encode
        end = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                ids = [x + end for x in ids_of(part.column("text").to_pylist())]
                names = part.column("doc_id").to_pylist()
                rows = pack_group([len(x) // 4 for x in ids], capacity)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d, *_ in rows], pa.int64()),
                        pa.array([s for _, s, _, _, _ in rows], pa.int64()),
                        pa.array([n for _, _, n, _, _ in rows], pa.int64()),
                        pa.array([ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in rows], pa.binary()),
                        pa.array([len(ids[d]) // 4 for d, *_ in rows], pa.int64()),
                        pa.array([first + w for _, _, _, w, _ in rows], pa.int64()),
                        pa.array([o for _, _, _, _, o in rows], pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
                first += max([w for _, _, _, w, _ in rows], default=-1) + 1

    docs = pick(docs, "doc_id", "text")
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, SCHEMA)
