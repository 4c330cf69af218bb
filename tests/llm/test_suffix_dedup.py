import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import suffix_dedup


def plain(rows):
    """(n_bytes, n_removed, n_spans, sha) by document, from a dictionary of all 100-byte strings."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        hit = np.zeros(len(raw) + 1, np.int8)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                hit[s : s + 100] = 1
            seen.add(w)
        spans = int((np.diff(hit, prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[hit[:-1] == 0]) if raw else b""
        out.append((len(raw), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted((r.doc_id is not None, r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect())


def check(spark, docs):
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    assert got(suffix_dedup.repeated_spans(docs)) == [(True, i, *x) for (i, _), x in zip(rows, plain(rows))]


def made(spark, n, seed):
    """Copies, overlaps, runs of one letter, shared passages of 90 to 300 bytes between other text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé\x00 ") for _ in range(rng.randint(1, 9)))
    shared = ["".join(word() for _ in range(rng.randint(18, 60))) for _ in range(6)] + ["z" * 250, "xy" * 80]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(shared) if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 60)))
        rows.append((i * 3, rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.2 else text))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("frequent", [1000, 3])
def test_made_texts(spark, monkeypatch, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "RECORDS", 700)
    monkeypatch.setattr(suffix_dedup, "SPANS", 50)
    for seed in range(2):
        check(spark, made(spark, 120, seed))


def test_like_brute_force(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = got(suffix_dedup.repeated_spans(odd_docs))
    assert len(rows) == odd_docs.count()
    by = {}
    for _, i, *x in rows:
        by.setdefault(i, []).append(x)
    assert by[3][0][0] == by[4][0][0] == by[10][0][1] == 0
    assert by[1] == [list(plain([odd_docs.where('doc_id = 1').select('doc_id', 'text').first()])[0])]
    assert len(by[2]) == 2 and by[2][0] == by[2][1] and by[2][0][1] == by[2][0][0]
    assert got(suffix_dedup.repeated_spans(no_docs)) == []
    assert suffix_dedup.without_repeats(odd_docs).columns == odd_docs.columns
    twice = spark.createDataFrame([(5, "k" * 99), (5, "k" * 150)], "doc_id long, text string")
    assert [r[3] for r in got(suffix_dedup.repeated_spans(twice))] == [0, 149]


def test_blocks_do_not_matter(monkeypatch):
    raw = np.frombuffer(random.Random(1).randbytes(5000), np.uint8) % 3
    ends = np.array([700, 701, 3000, 5000])

    def windows():
        return sorted((int(s), int(p)) for _, p, a, b in zip(*suffix_dedup.anchors(raw, ends)) for s in range(a, b + 1))

    want = windows()
    assert [s for s, _ in want] == [s for a, e in zip([0, *ends[:-1]], ends) for s in range(a, e - 99)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 333)
    assert windows() == want


def test_merge_and_front_coding():
    rng = random.Random(5)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(1, 30))) for _ in range(7)]
    prefix = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    order, lcps = suffix_dedup.merge([(r, [0] + [prefix(a, b) for a, b in zip(r, r[1:])]) for r in runs])
    out = [runs[r][i] for r, i in order]
    assert out == sorted(x for r in runs for x in r)
    assert lcps == [0] + [prefix(a, b) for a, b in zip(out, out[1:])]


def test_many_short_texts_in_a_partition():
    rng = random.Random(9)
    once = ["".join(rng.choice("абвгдежзийклмноп") for _ in range(50)) for _ in range(20_000)]
    texts = once + once
    raw, ends = suffix_dedup._joined(texts)
    _, p, first, last = suffix_dedup.anchors(raw, ends)
    doc = np.searchsorted(ends, p, side="right")
    v = p - np.concatenate(([0], ends))[doc] << 16 | p - last << 8 | p - first
    rows = pa.RecordBatch.from_arrays([pa.array(doc), pa.array([texts[i] for i in doc]), pa.array([[x] for x in v.tolist()])], ["k", "text", "vs"])
    runs = suffix_dedup._runs(SimpleNamespace(value=np.empty(0, np.uint64)), 1)([rows])
    out = suffix_dedup._by_document(suffix_dedup._merged(1)(runs))
    got = {k: suffix_dedup.spans_of(x) for batch in out for k, x in zip(batch.column("k").to_pylist(), batch.column("spans").to_pylist())}
    assert got == {i: [(0, 100)] for i in range(20_000, 40_000)}
