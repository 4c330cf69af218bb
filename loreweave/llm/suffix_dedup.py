"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier.

Every 100-byte string has one anchor, the smallest hashed 32-gram in it, so equal strings have it at the same place and
only the suffixes at anchors are sorted. Three steps, each one shuffle:

1. 32-gram hashes of the anchors are counted; anchors whose hash occurs once are dropped.
2. Slices of texts sort their remaining anchor suffixes (with what stands before them) into runs, front-code them, and send
   them by the hash of the key, the 32-gram. Equal records of a run are sent once. The key of a very frequent 32-gram is
   lengthened by all bytes that follow: each window is then a suffix of its own, with a key of 100 bytes, so no task gets a
   hot 32-gram. A key only says where records go; which are equal is found by sorting, byte by byte.
3. Bucket by bucket, runs are merged by a loser tree that compares only behind known common prefixes. From the common prefix
   lengths of the suffixes and of what stands before them follows which windows have an equal one earlier. Of equal records
   only the earliest is kept in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import by_place, cut, parallelism, pick, release

LENGTH, GRAM = 100, 32
#: 32-grams of a window.
GRAMS = LENGTH - GRAM + 1
#: Bytes that are hashed at once; a window's minimum also holds its place in 20 bits.
BLOCK, PLACE = 1 << 18, (1 << 20) - 1
#: Anchors of a 32-gram that are sorted together at most. So that a table of at most MOST_FREQUENT hashes (8 bytes each) goes
#: to every task, it is a share of all anchors if that is more: beyond 3.5 TB of text; 571 000 records of one key at 100 TB.
FREQUENT, MOST_FREQUENT = 20_000, 5_000_000
#: Bytes of text that are looked at together in steps 1 and 2.
SLICE = 2 << 20
#: Texts that step 2 looks at together: a text's number in its slice stands in the upper 15 bits of a signed 64-bit number.
SLICE_TEXTS = 1 << 15

#: Bytes of text to a bucket of hashes, and buckets at least. A slice sends a row to a bucket only if it has something for it.
BUCKET, LEAST_BUCKETS = 2 << 20, 64
#: Bytes of text to a partition of a shuffle.
PARTITION = 64 << 20
#: Records that are sorted into one run, or held of a bucket before equal ones are looked for. Spans that are sent on together.
RECORDS, SPANS = 1 << 17, 1 << 18

_RNG = np.random.default_rng(100)
TABLES = _RNG.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(raw: np.ndarray, length: int, table: int = 0) -> np.ndarray:
    """Polynomial hashes of all strings of `length` bytes, by doubling."""
    x, n, factor = TABLES[table][raw], 1, FACTORS[table]
    out, done = None, 0
    while True:
        if length & n:  # the part of n bytes that follows what is done
            if out is None:
                out, done = x, n
            else:
                size = len(raw) - done - n + 1
                out = out[:size] * np.uint64(pow(factor, n, 1 << 64)) + x[done : done + size]
                done += n
        if done == length:
            return _mixed(out)
        x = x[:-n] * np.uint64(pow(factor, n, 1 << 64)) + x[n:]
        n *= 2


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined in raw, which end before `ends`: hash and place of each anchor, and its first and last window.

    A window is left out unless it lies in one text. Long input is hashed block by block.
    """
    hs, ps, firsts, lasts = [], [], [], []
    for at in range(0, len(raw) - LENGTH + 1, BLOCK):
        part = raw[at : at + BLOCK + LENGTH - 1]
        h = _hashes(part, GRAM)
        m = (h & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= GRAMS:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        m = np.minimum(m[: len(part) - LENGTH + 1], m[GRAMS - n :])
        places = np.arange(at, at + len(m))
        starts = np.flatnonzero(places + LENGTH <= ends[np.searchsorted(ends, places, side="right")])
        if not len(starts):
            continue
        p = (m[starts] & np.uint64(PLACE)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1))))
        hs.append(h[p[new]])
        ps.append(p[new] + at)
        firsts.append(starts[new] + at)
        lasts.append(starts[np.append(new[1:] - 1, len(starts) - 1)] + at)
    if not hs:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return np.concatenate(hs), np.concatenate(ps), np.concatenate(firsts), np.concatenate(lasts)


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts])


# Entries between the steps. v holds the anchor's place in its text and how far before it its windows start: least, most.
SEEN = np.dtype([("h", "<u8"), ("k", "<u4"), ("p", "<u4"), ("least", "u1"), ("most", "u1"), ("n", "<u4")])
COVER = np.dtype([("k", "<i8"), ("s", "<u4"), ("e", "<u4")])
#: A record of a run: the suffix up to the last window's end, its length, what stands before it, nearest first, and `most`.
WIDTH = LENGTH + 1 + GRAMS - 1 + 1
ENTRY = np.dtype([("k", "<i8"), ("p", "<u4"), ("least", "u1"), ("most", "u1"), ("lcp", "u1")])

FOUND, REPEATED, RUN, COVERED = range(4)
ROWS = "bucket int, kind int, blob binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])


def _split(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that groups by bucket, and (bucket, start, stop) in it."""
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return order, []
    found, starts = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True))


# Step 1


def _look(buckets: int):
    """Anchors of each slice of texts: one entry per hash goes to the hash's bucket; those that the slice repeats are sent on."""

    def slices(batches):
        for batch in batches:
            keys, texts = batch.column("k").to_pylist(), batch.column("text").to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= SLICE or i == len(texts) - 1:
                    yield keys[start : i + 1], texts[start : i + 1]
                    start, size = i + 1, 0

    def run(batches):
        release()
        for keys, texts in slices(batches):
            raw, ends = _joined(texts)
            h, p, first, last = anchors(raw, ends)
            if not len(h):
                continue
            doc = np.searchsorted(ends, p, side="right")
            k = np.array(keys, np.int64)[doc]
            at = p - np.concatenate(([0], ends))[doc]
            base = int(k.min())
            wide = int(k.max()) - base >= 1 << 32
            order = np.argsort(h, kind="stable")
            new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            count = np.diff(np.append(np.flatnonzero(new), len(h)))
            rows = []
            again = order[np.repeat(count > 1, count)]
            if len(again):
                rows.append((int(k[again[0]]) % buckets, REPEATED, _packed(k[again], at[again], (p - last)[again], (p - first)[again]).tobytes()))
            one = order[new]
            out = np.empty(len(one), SEEN)
            out["h"], out["p"], out["least"], out["most"], out["n"] = h[one], at[one], (p - last)[one], (p - first)[one], count
            out["k"] = 0 if wide else k[one] - base
            groups, spans = _split((out["h"] % np.uint64(buckets)).astype(np.int64))
            for b, s, e in spans:
                part = groups[s:e]
                if wide:
                    blob = b"\1" + k[one][part].astype("<i8").tobytes()
                else:
                    blob = b"\0" + base.to_bytes(8, "little", signed=True)
                rows.append((b, FOUND, blob + out[part].tobytes()))
            yield _batch(rows)

    return run


def _packed(k, p, least, most) -> np.ndarray:
    out = np.empty(len(k), [("k", "<i8"), ("v", "<i8")])
    out["k"], out["v"] = k, p.astype(np.int64) << 16 | least.astype(np.int64) << 8 | most.astype(np.int64)
    return out


def _count(frequent: int):
    """Of the entries of some buckets, which come bucket by bucket: (k, v) of those whose hash occurs twice or more; with k null, v a frequent hash."""

    def told(blobs: list[bytes]) -> pa.RecordBatch:
        hs, ks, vs, ns = [], [], [], []
        for blob in blobs:
            if blob[0]:
                n = (len(blob) - 1) // (8 + SEEN.itemsize)
                x, k = np.frombuffer(blob, SEEN, offset=1 + 8 * n), np.frombuffer(blob, "<i8", n, 1)
            else:
                x = np.frombuffer(blob, SEEN, offset=9)
                k = x["k"].astype(np.int64) + int.from_bytes(blob[1:9], "little", signed=True)
            hs.append(x["h"])
            ks.append(k)
            vs.append(x["p"].astype(np.int64) << 16 | x["least"].astype(np.int64) << 8 | x["most"])
            ns.append(x["n"])
        h, k, v, n = (np.concatenate(x) for x in (hs, ks, vs, ns))
        order = np.argsort(h, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        total = np.add.reduceat(n[order].astype(np.int64), starts)
        size = np.diff(np.append(starts, len(h)))
        #: Entries of several slices; what one slice repeats it has sent on itself.
        several = order[np.repeat(size > 1, size)]
        several = several[n[several] == 1]
        hot = h[order][starts[total > frequent]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(k[several]), pa.nulls(len(hot), pa.int64())]), pa.array(np.concatenate((v[several], hot)))], ["k", "v"])

    def run(batches):
        release()
        now, held = None, []
        for batch in batches:
            for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket != now and held:
                    yield told(held)
                    held = []
                now = bucket
                if kind == REPEATED:
                    x = np.frombuffer(blob, [("k", "<i8"), ("v", "<i8")])
                    yield pa.RecordBatch.from_arrays([pa.array(x["k"]), pa.array(x["v"])], ["k", "v"])
                else:
                    held.append(blob)
        if held:
            yield told(held)

    return run


# Step 2


def _covered(k, s, e) -> np.ndarray:
    out = np.empty(len(k), COVER)
    out["k"], out["s"], out["e"] = k, s, e
    return out


def _runs(frequent: np.ndarray, buckets: int):
    """Sorted front-coded runs of a partition's repeated anchors, slice by slice; frequent: a broadcast of sorted hashes of 32-grams."""

    def run(batches):
        release()
        hot, docs, size = frequent.value, [], 0
        for batch in batches:
            for doc in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), batch.column("vs").to_pylist(), strict=True):
                docs.append(doc)
                size += len(doc[1])
                if size >= SLICE or len(docs) == SLICE_TEXTS:
                    yield _batch(list(_slice(docs, hot, buckets)))
                    docs, size = [], 0
        if docs:
            yield _batch(list(_slice(docs, hot, buckets)))

    return run


def _slice(docs, frequent: np.ndarray, buckets: int):
    docs = sorted(docs, key=lambda x: x[0])
    raw, ends = _joined([t for _, t, _ in docs])
    begins = np.concatenate(([0], ends[:-1]))
    n = np.array([len(v) for _, _, v in docs])
    v = np.sort(np.concatenate([np.array(x, np.int64) for _, _, x in docs]) + (np.repeat(np.arange(len(docs)), n) << 48))
    doc, v = v >> 48, v & (1 << 48) - 1
    place, least, most = v >> 16, v >> 8 & 255, v & 255
    p, k = place + begins[doc], np.array([x[0] for x in docs], np.int64)[doc]
    grams = TABLES[0][sliding_window_view(raw, GRAM)[p]]
    size = 1
    while size < GRAM:
        grams = grams[:, ::2] * np.uint64(pow(FACTORS[0], size, 1 << 64)) + grams[:, 1::2]
        size *= 2
    h = _mixed(grams[:, 0])
    del grams
    text = np.concatenate((np.zeros(GRAMS - 1, np.uint8), raw, np.zeros(LENGTH, np.uint8)))
    often = np.zeros(len(h), bool)
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    parts = [x[~often] for x in (p, place, least, most, k, h)]
    for at in range(0, len(parts[0]), RECORDS):
        yield from _run(text, *[x[at : at + RECORDS] for x in parts], buckets)
    if not often.any():
        return
    whole = _hashes(raw, LENGTH)
    p, place, least, most, k = (x[often] for x in (p, place, least, most, k))
    step = RECORDS // GRAMS
    for at in range(0, len(p), step):
        some = slice(at, at + step)
        n = most[some] - least[some] + 1
        back = np.repeat(most[some], n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        starts, none = np.repeat(p[some], n) - back, np.zeros(len(back), np.int64)
        yield from _run(text, starts, np.repeat(place[some], n) - back, none, none, np.repeat(k[some], n), whole[starts], buckets)


def _run(text, p, place, least, most, k, key, buckets: int):
    """Records of anchors in the order of (k, place), sorted and front-coded by bucket of the key. text: the joined texts within zeros."""
    record = np.zeros((len(p), WIDTH), np.uint8)
    record[:, :LENGTH] = sliding_window_view(text, LENGTH)[p + GRAMS - 1] * (np.arange(LENGTH) < (LENGTH - least)[:, None])
    record[:, LENGTH] = LENGTH - least
    record[:, LENGTH + 1 : -1] = sliding_window_view(text, GRAMS - 1)[p][:, ::-1] * (np.arange(GRAMS - 1) < most[:, None])
    record[:, -1] = most + 1
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(record.reshape(-1).view(f"S{WIDTH}"), kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    r, b = record[order], bucket[order]
    differ = r[1:] != r[:-1]
    lcp = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)))
    lcp[np.concatenate(([True], b[1:] != b[:-1]))] = 0
    same = lcp == WIDTH
    twin = order[same]  # every window of these has an equal one earlier in this run
    if len(twin):
        yield int(k[twin[0]]) % buckets, COVERED, _covered(k[twin], place[twin] - most[twin], place[twin] - least[twin] + LENGTH).tobytes()
    order, r, lcp, b = order[~same], r[~same], lcp[~same], b[~same]
    entry = np.empty(len(order), ENTRY)
    entry["k"], entry["p"], entry["least"], entry["most"], entry["lcp"] = k[order], place[order], least[order], most[order], lcp
    found, starts = np.unique(b, return_index=True)
    for x, s, e in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
        yield x, RUN, entry[s:e].tobytes() + r[s:e][_told(entry[s:e])].tobytes() + (e - s).to_bytes(4, "little")


def _told(entry: np.ndarray) -> np.ndarray:
    """Which bytes of the records are in the code: behind the common prefix, and neither padding nor known from the entry."""
    at = np.arange(WIDTH)
    suffix = at < LENGTH - entry["least"].astype(np.int64)[:, None]
    before = (at > LENGTH) & (at <= LENGTH + entry["most"].astype(np.int64)[:, None])
    return (at >= entry["lcp"][:, None]) & (suffix | before)


# Step 3


def decode(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Entries and records of a front-coded run."""
    n = int.from_bytes(blob[-4:], "little")
    entry = np.frombuffer(blob, ENTRY, n)
    told = _told(entry)
    record = np.zeros((n, WIDTH), np.uint8)
    record[told] = np.frombuffer(blob, np.uint8, int(told.sum()), n * ENTRY.itemsize)
    record[:, LENGTH] = LENGTH - entry["least"]
    record[:, -1] = entry["most"] + 1
    row = np.maximum.accumulate(np.where(np.arange(WIDTH) >= entry["lcp"][:, None], np.arange(n)[:, None], 0), axis=0)
    return entry, np.take_along_axis(record, row, axis=0)


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """(run, row) of all records in order and each one's common prefix length with the one before.

    A loser tree: inner nodes hold the loser of their match with its common prefix with the winner, so records are compared
    only from where they are known to agree. Equal records go by run.
    """
    width = len(runs[0][0][0]) if runs else 0
    count = 1
    while count < len(runs):
        count *= 2
    end = len(runs)
    row = [0] * (count + 1)
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (count - end)
    sizes = [len(r[0]) for r in runs]
    known = [0] * count  # common prefix of a run's head with the last record that won

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; known[loser] becomes the common prefix with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        p, q = known[a], known[b]
        if p != q:  # the longer known prefix is smaller; the other's stays
            return (a, b) if p > q else (b, a)
        d = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
        if not d:
            known[max(a, b)] = width
            return (a, b) if a < b else (b, a)
        p = width - (d.bit_length() + 7) // 8
        if x[p] < y[p]:
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    losers = [0] * count
    winners = [0] * count + list(range(count))
    for node in range(count - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if count > 1 else 0
    out, lcps = [], []
    for _ in range(sum(sizes)):
        i = row[best]
        out.append((best, i))
        lcps.append(known[best])
        i += 1
        row[best] = i
        if i < sizes[best]:
            head[best] = runs[best][0][i]
            known[best] = runs[best][1][i]
        else:
            head[best] = None
        node = (best + count) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1
    if lcps:
        lcps[0] = 0
    return out, lcps


def resolve(entry: np.ndarray, record: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Covered spans of anchors in the order of their records: windows that have an equal one at a smaller (k, place)."""
    n = len(entry)
    before = np.ascontiguousarray(record[:, LENGTH + 1 : -1])
    left = np.argsort(before.reshape(-1).view(f"S{GRAMS - 1}"), kind="stable")
    differ = before[left][1:] != before[left][:-1]
    left_lcp = np.concatenate(([0], np.where(differ.any(axis=1), differ.argmax(axis=1), GRAMS - 1))) if n else np.empty(0)
    earliest = np.lexsort((entry["p"], entry["k"]))
    again = np.zeros((n, GRAMS + 1), bool)
    least, most = entry["least"].astype(np.int64)[earliest], entry["most"].astype(np.int64)[earliest]
    left_class = np.empty(n, np.int64)
    for d in range(GRAMS):
        some = earliest[(least <= d) & (d <= most)]
        if len(some) < 2:
            continue
        right_class = np.cumsum(lcp < LENGTH - d)
        left_class[left] = np.cumsum(left_lcp < d) if d else 0
        key = right_class[some] * (n + 1) + left_class[some]
        order = np.argsort(key, kind="stable")
        same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
        again[some[order[same]], d] = True
    edges = np.diff(np.concatenate((np.zeros((n, 1), np.int8), again.astype(np.int8)), axis=1), axis=1)
    rows, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    p = entry["p"].astype(np.int64)[rows]
    return _covered(entry["k"][rows], p - (high - 1), p - low + LENGTH)


class Bucket:
    """The runs of one bucket. When many records are held they are merged into one run, of equal records only the earliest."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, list[bytes], list[int]]] = []
        self.held, self.most = 0, RECORDS
        self.covered: list[np.ndarray] = []

    def add(self, blob: bytes) -> None:
        entry, record = decode(blob)
        raw = record.tobytes()
        self.runs.append((entry, [raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)], entry["lcp"].tolist()))
        self.held += len(entry)
        if self.held > self.most:
            self._merge()
            self.most = 2 * self.held + RECORDS

    def _merge(self) -> None:
        order, lcp = merge([(rows, known) for _, rows, known in self.runs])
        starts = np.cumsum([0, *[len(entry) for entry, _, _ in self.runs]])
        at = np.array([starts[r] + i for r, i in order])
        entry, lcp = np.concatenate([entry for entry, _, _ in self.runs])[at], np.array(lcp)
        rows = [self.runs[r][1][i] for r, i in order]
        self.runs.clear()
        new = lcp < WIDTH
        new[0] = True
        group = np.cumsum(new) - 1
        early = np.lexsort((entry["p"], entry["k"], group))
        first = early[np.flatnonzero(np.concatenate(([True], np.diff(group[early]) > 0)))]
        if len(first) < len(entry):
            rest = np.ones(len(entry), bool)
            rest[first] = False
            x = entry[rest]
            p = x["p"].astype(np.int64)
            self.covered.append(_covered(x["k"], p - x["most"], p - x["least"] + LENGTH))
            entry, lcp, rows = entry[first], lcp[new], [rows[i] for i in first.tolist()]
        self.runs.append((entry, rows, lcp.tolist()))
        self.held = len(rows)

    def spans(self) -> list[np.ndarray]:
        """Covered spans of all its records."""
        if self.runs:
            self._merge()
            entry, rows, lcp = self.runs.pop()
            self.covered.append(resolve(entry, np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH), np.array(lcp)))
        return self.covered


def _merged(groups: int):
    """Covered spans of the runs of some buckets, which come bucket by bucket, for groups of documents."""

    def ready(found: list[np.ndarray]) -> pa.RecordBatch:
        c = np.concatenate(found)
        order, spans = _split(c["k"] % groups)
        return _batch([(b, COVERED, c[order[s:e]].tobytes()) for b, s, e in spans])

    def run(batches):
        release()
        found, size, now, held = [], 0, None, Bucket()
        for batch in batches:
            for bucket, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if bucket != now:
                    found += held.spans()
                    now, held = bucket, Bucket()
                if kind == COVERED:
                    found.append(np.frombuffer(blob, COVER))
                else:
                    held.add(blob)
            size = sum(map(len, found))
            if size >= SPANS:
                yield ready(found)
                found = []
        found += held.spans()
        if sum(map(len, found)):
            yield ready(found)

    return run


def _by_document(batches):
    """One row per document of some groups: all its covered spans."""
    parts = [np.frombuffer(blob, COVER) for batch in batches for blob in batch.column("blob").to_pylist()]
    if parts:
        c = np.concatenate(parts)
        order, spans = _split(c["k"])
        ends = np.stack([c["s"][order], c["e"][order]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in spans], pa.int64()), pa.array([ends[s:e].tobytes() for _, s, e in spans], pa.binary())], ["k", "spans"])


def spans_of(blob: bytes | None) -> list[tuple[int, int]]:
    """Maximal covered spans."""
    if not blob:
        return []
    x = np.frombuffer(blob, "<u4").reshape(-1, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    top = np.maximum.accumulate(x[:, 1])
    new = np.flatnonzero(np.concatenate(([True], x[1:, 0] > top[:-1])))
    return list(zip(x[new, 0].tolist(), top[np.append(new[1:] - 1, len(x) - 1)].tolist(), strict=True))


def _ranked(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with k, the rank of the row among all by (doc_id, size, hash of the text)."""

    def number(batches):
        part, i = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(np.arange(i, i + batch.num_rows))], [*batch.schema.names, "part", "i"])
            i += batch.num_rows

    of = [F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")]
    order = ["doc_id", "size", "hash"]
    keys = docs.select(*of).distinct().repartitionByRange(parallelism(docs.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(number, "doc_id long, size int, hash long, part int, i long")
    keys = cut(keys, "keys")
    parts = keys.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    keys = keys.join(F.broadcast(parts), "part").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("hash").alias("_hash"), (F.col("before") + F.col("i")).alias("k"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.octet_length(F.coalesce("text", F.lit(""))) == F.col("_size")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    return docs.join(keys, same).select(*docs.columns, "k")


def covered(docs: DataFrame, texts: DataFrame, size: int, n: int) -> DataFrame:
    """The covered spans (k, spans) of the docs (k, text and more) that have any, n partitions by k; k is unique and orders them.

    docs: dealt to n partitions by k, so that its exchange can be used again; texts: (k, text) of docs before; size: bytes of texts.
    """
    frequent = max(FREQUENT, size // 35 // MOST_FREQUENT)
    buckets = max(LEAST_BUCKETS, size // BUCKET)
    seen = texts.where(F.octet_length("text") >= LENGTH).mapInArrow(_look(buckets), ROWS)
    told = cut(seen.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(frequent), "k long, v long"), "repeated")
    #: Anchors are 35 bytes apart or more on average, so that at most about MOST_FREQUENT hashes can be frequent.
    hot = np.sort(told.where("k IS NULL").select("v").toArrow()["v"].to_numpy().view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    replies = told.where("k IS NOT NULL").repartition(n, "k").groupBy("k").agg(F.collect_list("v").alias("vs"))
    runs = docs.join(replies.hint("shuffle_hash"), "k").select(*docs.columns, "vs").mapInArrow(_runs(shared, buckets), ROWS)
    spans = runs.repartition(2 * n, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged(n), ROWS)
    return spans.repartition(n, "bucket").mapInArrow(_by_document, "k long, spans binary").repartition(n, "k")


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text and more) with k and spans. Where ids are null or repeated, k is a rank; else it is the id.

    The number of partitions follows from the bytes, so what a task holds, also of the hashed side of a join, doesn't grow
    with the table.
    """
    rows, ids, size = docs.agg(F.count("*"), F.count_distinct("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(parallelism(docs.sparkSession), -(-size // PARTITION))
    keyed = (docs.withColumn("k", F.col("doc_id")) if rows == ids else _ranked(docs)).where("k IS NOT NULL")
    dealt = keyed.repartition(n, "k")
    one = dealt if rows == ids else dealt.dropDuplicates(["k"])
    spans = covered(one, keyed.select("k", "text") if rows == ids else one.select("k", "text"), size, n)
    return dealt.join(spans.hint("shuffle_hash"), "k", "left")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed byte spans) and kept_sha256, one row per row of docs (doc_id, text).

    A byte is removed if a 100-byte string that covers it also starts earlier: in a document of a smaller id, or earlier in
    the same one. Matches do not cross documents. Null and empty texts have no bytes and lose none. Null ids come first; rows
    of one id are documents in the order of their text's size and hash, and equal rows are one document. An empty table
    gives an empty one.
    """

    def run(batches):
        for batch in batches:
            size, removed, cuts, sha = [], [], [], []
            for text, blob in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                found = spans_of(blob)
                size.append(len(raw))
                removed.append(sum(e - s for s, e in found))
                cuts.append([{"start": s, "end": e} for s, e in found])
                sha.append(hashlib.sha256(without(raw, found)).hexdigest())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, kind), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    rows = pick(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return _with_spans(rows).select("doc_id", "text", "k", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id long, text and more) with the repeated bytes cut out of text, and n_chars, if there, counted anew.

    A character of which a cut leaves a part goes with it. Texts that are repeats as a whole become empty; no row goes. Other
    columns, also such as clash with names that are used here, stay as they are.
    """
    names, docs = docs.columns, by_place(docs, "doc_id", "text", "n_chars")
    inner = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, blob in enumerate(batch.column("spans").to_pylist()):
                if blob:
                    texts[i] = without(texts[i].encode("utf-8", "surrogatepass"), spans_of(blob)).decode("utf-8", "ignore")
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).select(inner)

    out = _with_spans(docs).select(*inner, "k", "spans").mapInArrow(run, docs.schema)
    out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
    return out.toDF(*names)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])
