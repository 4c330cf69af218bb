"""Quality classifier: expectation-maximisation over heuristic labellers, whose posterior labels train a hashed linear scorer."""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_place, cut, pick, release
from loreweave.llm.quality_rules import STOP_WORDS, SYMBOLS
from loreweave.llm.samples import place, threshold

#: Documents whose posterior labels train the scorer, at most about so many.
MOST_LABELLED = 8000
BUCKETS = 1 << 11
EPOCHS, RATE, DECAY = 200, 0.05, 1e-4
ROUNDS = 100
#: Words whose shapes a worker remembers, and their longest; others are looked at anew.
MOST_WORDS, LONGEST = 100_000, 40

ABSTAIN, BAD, GOOD = "-", "0", "1"
_STOP = frozenset(STOP_WORDS)
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128))


def measures(text: str | None) -> tuple[list[str], dict[str, float]]:
    """The words of a text and its ratios; without words every ratio is 0."""
    text = text or ""
    ws = text.split()
    raw = text.encode("utf-8", "surrogatepass")
    n, lines = len(ws), [x for x in text.split("\n") if x.strip()]
    letters = len(raw.translate(None, _LETTERS))
    per = lambda x, y: x / y if y else 0.0
    return ws, {
        "symbols": per(sum(raw.count(c) for c in SYMBOLS.encode()), len(raw)),
        "capitals": per(len(raw.translate(None, _UPPER)), letters),
        "marks": per(raw.count(b"!") + raw.count(b"?"), n),
        "same": per(sum(map(operator.eq, ws, islice(ws, 1, None))), n),
        "lines": per(len(lines) - len(set(lines)), len(lines)),
        "stop": per(sum(map(_STOP.__contains__, ws)), n),
        "unique": per(len(set(ws)), n),
    }


#: (measure, bad if, good if): overlapping heuristics; between the bounds a labeller abstains.
LABELLERS = (
    ("symbols", lambda x, n: x > 0.05, lambda x, n: x < 0.01),
    ("capitals", lambda x, n: x > 0.4, lambda x, n: x < 0.15),
    ("marks", lambda x, n: x > 0.2, lambda x, n: x < 0.02),
    ("same", lambda x, n: x > 0.1, lambda x, n: x < 0.02),
    ("lines", lambda x, n: x > 0.5, lambda x, n: x < 0.1),
    ("stop", lambda x, n: n >= 30 and x < 0.03, lambda x, n: x > 0.1),
    ("unique", lambda x, n: n >= 30 and x < 0.2, lambda x, n: x > 0.4),
)


def votes(n: int, m: dict[str, float]) -> str:
    return "".join(BAD if bad(m[k], n) else GOOD if n and good(m[k], n) else ABSTAIN for k, bad, good in LABELLERS)


def estimate(counts: dict[str, int]) -> dict[str, float]:
    """Expectation-maximisation: each labeller's vote probabilities under both classes, and so P(good) for each vote pattern."""
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    seen = np.array([[[c == v for v in (ABSTAIN, BAD, GOOD)] for c in p] for p in patterns], float)
    good = np.array([(1 + p.count(GOOD)) / (2 + p.count(GOOD) + 3 * p.count(BAD)) for p in patterns])
    for _ in range(ROUNDS):
        both = np.stack([weight * (1 - good), weight * good])
        prior = (both.sum(axis=1) + 1) / (both.sum() + 2)
        told = np.einsum("cp,plv->clv", both, seen) + 0.5
        told /= told.sum(axis=2, keepdims=True)
        like = np.log(prior)[:, None] + np.einsum("clv,plv->cp", np.log(told), seen)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(patterns, good.tolist(), strict=True))


def shape(word: str) -> int:
    """A number for the run-length-free pattern of a word's capitals, small letters, digits and marks."""
    out = ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return zlib.crc32(out.encode("utf-8", "surrogatepass"))


class Features:
    """Hashed features: shares of word shapes and of pairs of shapes, and the ratios of measures()."""

    def __init__(self):
        self.shapes: dict[str, int] = {}
        self.named = {k: zlib.crc32(f"ratio {k}".encode()) % BUCKETS for k, *_ in LABELLERS}

    def __call__(self, ws: list[str], m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        known = self.shapes
        ids = list(map(known.get, ws))
        if None in ids:
            now = {w: shape(w) for w, x in zip(ws, ids, strict=True) if x is None}
            ids = [x if x is not None else now[w] for w, x in zip(ws, ids, strict=True)]
            if len(known) < MOST_WORDS:
                known.update((w, s) for w, s in now.items() if len(w) <= LONGEST)
        x = np.array(ids, np.uint64)
        y = (x[:-1] * np.uint64(0x9E3779B1) + x[1:]) % np.uint64((1 << 61) - 1)
        out = np.bincount(np.concatenate([x, y]).astype(np.int64) % BUCKETS, minlength=BUCKETS) / max(1, len(ws))
        for k, b in self.named.items():
            out[b] += m[k]
        at = np.flatnonzero(out)
        return at.astype("<i4"), out[at].astype("<f4")


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def __call__(self, at: np.ndarray, values: np.ndarray) -> float:
        z = float(self.weights[at] @ values) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Scorer:
    """Logistic regression on soft labels, both classes of equal weight, by full-batch Adam."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (at, values) in enumerate(rows):
        x[i, at] = values
    y = labels.astype(np.float32)
    share = np.clip(np.array([(1 - y).sum(), y.sum()]), 1.0, None)
    weight = ((1 - y) / share[0] + y / share[1]) / 2
    w, b = np.zeros(BUCKETS + 1, np.float32), BUCKETS
    a, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:b] + w[b], -50, 50)))
        d = (p - y) * weight
        g = np.append(x.T @ d + DECAY * w[:b], d.sum())
        a += 0.1 * (g - a)
        v += 0.001 * (g * g - v)
        w -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Scorer(w[:b].astype(float), float(w[b]))


def learn(docs: DataFrame, most: int = MOST_LABELLED) -> Scorer | None:
    """Vote patterns are counted over all docs (doc_id, text); the scorer is fitted to a bounded sample with its posterior labels.

    The sample goes by the hash of id and text, so null and repeated ids don't matter; of equal rows at most 2 * most are
    learned from. Null texts teach nothing. No documents: no scorer.
    """
    docs = pick(docs, "doc_id", "text").where("text IS NOT NULL")
    hashed = place("doc_id", "text", seed=11)
    total, least = docs.agg(F.count("*"), F.min(hashed)).first()
    if not total:
        return None
    taken = F.when(hashed < F.lit(threshold(total, least, most)), hashed)

    def look(batches):
        release()
        features = Features()
        for batch in batches:
            pattern, at, values = [], [], []
            for text, chosen in zip(batch.column("text").to_pylist(), batch.column("taken").to_pylist(), strict=True):
                ws, m = measures(text)
                pattern.append(votes(len(ws), m))
                found = features(ws, m) if chosen is not None else None
                at.append(found and found[0].tobytes())
                values.append(found and found[1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("taken"), pa.array(pattern), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["taken", "votes", "at", "values"])

    seen = cut(docs.select("text", taken.alias("taken")).mapInArrow(look, "taken long, votes string, at binary, `values` binary"), "votes")
    counts = {r[0]: r[1] for r in seen.groupBy("votes").count().collect()}  # at most 3 ** len(LABELLERS) patterns
    good = estimate(counts)
    some = sorted((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in seen.where("at IS NOT NULL").orderBy("taken", "votes", "at", "values").limit(2 * most).collect())
    return fit([(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4")) for _, _, a, v in some], np.array([good[p] for _, p, _, _ in some]))


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and kept (score of 0.5 or more) for every whole text; without words 0 and not kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        release()
        scorer, features = shared.value, Features()
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                ws, m = measures(text)
                out.append(scorer(*features(ws, m)) if ws and scorer else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = pick(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, score double").withColumn("kept", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """docs without those that the scorer rejects; all columns stay, and each row is judged on its own."""
    names, docs = docs.columns, by_place(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        release()
        scorer, features = shared.value, Features()
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                ws, m = measures(text)
                keep.append(bool(ws) and scorer is not None and scorer(*features(ws, m)) >= 0.5)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema).toDF(*names)
