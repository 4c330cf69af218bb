"""Toxicity: bags of subword embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import held_out, pick
from loreweave.llm.decontaminate import words
from loreweave.llm.samples import bounded

#: Labelled documents of each label that are learned from, at most about so many.
MOST_LABELLED = 4000
#: Bytes of their texts at most, but for the last one.
MOST_BYTES = 64 << 20
BUCKETS = 1 << 16
DIMENSION = 4
SHORTEST, LONGEST = 3, 5
#: Scales averages, so that one word in some hundred can decide.
SCALE = 30.0
#: Zero vectors that are averaged with every text, so that few words weigh less.
PAD = 50
EPOCHS, RATE, DECAY = 100, 0.05, 1e-4
#: Share of a matrix's mean step scale that every step is damped by, so that rare n-grams move less.
DAMPING = 0.3
#: Characters of a word at most. Longer ones, such as text without blanks, are words of so many characters, each
#: overlapping the one before by all but one of an n-gram's characters, so that no n-gram is lost.
WORD_CHARS, OVERLAP = 40, LONGEST - 1
MOST_WORDS = 400_000
#: Entries that are summed at once in training.
BLOCK = 1 << 16


def pieces(text: str | None) -> list[bytes]:
    """The words of a text; in place of a word of more than WORD_CHARS characters, its overlapping pieces."""
    ws = words(text)
    if max(map(len, ws), default=0) <= WORD_CHARS:  # bytes are never fewer than characters
        return ws
    out = []
    for w in ws:
        s = w.decode("utf-8", "surrogatepass") if len(w) > WORD_CHARS else ""
        if len(s) <= WORD_CHARS:
            out.append(w)
        else:
            out += [s[i : i + WORD_CHARS].encode("utf-8", "surrogatepass") for i in range(0, len(s) - OVERLAP, WORD_CHARS - OVERLAP)]
    return out


def subwords(word: bytes) -> list[int]:
    """Buckets of the word's character n-grams and of the word itself, with its bounds."""
    w = "<" + word.decode("utf-8", "replace") + ">"
    n = len(w)
    return [zlib.crc32(w[i : i + k].encode()) % BUCKETS for k in range(SHORTEST, LONGEST + 1) for i in range(n - k + 1)] + [zlib.crc32(w.encode()) % BUCKETS]


@dataclass
class Model:
    """gain: what a bucket adds to the logit of label 1; the average over a text's words is scaled and the bias added."""

    gain: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        ids = subwords(word)
        return math.fsum(self.gain[i] for i in ids) / len(ids)


class Sums:
    """Sums of rows, entry by entry: row `take[i]` of the values counts towards target `to[i]`. Works block by block."""

    def __init__(self, take: np.ndarray, to: np.ndarray, weight: np.ndarray | None = None):
        if np.any(to[1:] < to[:-1]):
            order = np.argsort(to, kind="stable")
            take, to, weight = take[order], to[order], None if weight is None else weight[order]
        self.take, self.weight = take, weight
        self.starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        self.found = to[self.starts]
        at = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(to), BLOCK)), len(self.starts)))
        stops = np.append(self.starts, len(to))
        self.blocks = [(a, b, int(stops[a]), int(stops[b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def of(self, values: np.ndarray, n: int) -> np.ndarray:
        """n sums; targets without entries get 0."""
        some = np.empty((len(self.found), values.shape[1]), np.float32)
        for a, b, s, e in self.blocks:
            part = np.take(values, self.take[s:e], axis=0)
            if self.weight is not None:
                part *= self.weight[s:e, None]
            some[a:b] = np.add.reduceat(part, self.starts[a:b] - s, axis=0)
        out = np.zeros((n, values.shape[1]), np.float32)
        out[self.found] = some
        return out


def bag(text: str | None) -> tuple[list[bytes], list[int]]:
    """The distinct words of a text in order, and how often each occurs."""
    counts = Counter(pieces(text))
    return list(counts), list(counts.values())


def train(texts: list[str | None], labels: list[int], seed: int = 0) -> Model:
    return fit(map(bag, texts), labels, seed)


def gradients(parameters: list[np.ndarray], forward: tuple, backward: tuple, share: np.ndarray, one_hot: np.ndarray, balance: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The class-balanced cross-entropy and its gradients by the embeddings, the softmax weights and the bias."""
    (to_words, n_words), (to_docs, n_docs) = forward
    from_docs, from_words = backward
    e, w, b = parameters
    h = SCALE * to_docs.of(to_words.of(e, n_words) * share, n_docs)
    z = h @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    dz = (p - one_hot) * balance
    de = from_words.of(from_docs.of(SCALE * (dz @ w.T), n_words) * share, len(e))
    loss = -float((balance[:, 0] * np.log((p * one_hot).sum(axis=1) + 1e-30)).sum())
    return loss, [de, h.T @ dz, dz.sum(axis=0)]


def fit(found: Iterable[tuple[list[bytes], list[int]]], labels: list[int], seed: int = 0) -> Model:
    """Embeddings and softmax weights by full-batch Adam on the class-balanced cross-entropy of bags of words. One label alone: its constant."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 8.0 if labels and labels[0] == 1 else -8.0)
    names: dict[bytes, int] = {}
    bags = []
    for ws, counts in found:
        ids = np.fromiter((names.setdefault(w, len(names)) for w in ws), np.int32, len(ws))
        bags.append((ids, np.array(counts, np.int64)))
    if not names:
        return Model(np.zeros(BUCKETS), 0.0)
    raw, length = array("i"), []
    for w in names:
        ids = subwords(w)
        raw.extend(ids)
        length.append(len(ids))
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), [len(ids) for ids, _ in bags])
    word = np.concatenate([ids for ids, _ in bags])
    weight = np.concatenate([(n / (n.sum() + PAD)).astype(np.float32) for _, n in bags])
    n_docs, n_words = len(bags), len(names)
    del names, bags
    owner = np.repeat(np.arange(n_words, dtype=np.int32), length)
    raw = np.frombuffer(raw, np.int32)
    share = 1.0 / np.array(length, np.float32)[:, None]
    used = np.unique(raw)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    bucket = place[raw]
    forward = (Sums(bucket, owner), n_words), (Sums(word, doc, weight), n_docs)
    backward = Sums(doc, word, weight), Sums(owner, bucket)
    del raw, owner, bucket, doc, word, weight

    rng = np.random.default_rng(seed)
    parameters = [
        rng.normal(0, 0.01, (len(used), DIMENSION)).astype(np.float32),
        rng.normal(0, 0.3, (DIMENSION, 2)).astype(np.float32),
        np.zeros(2, np.float32),
    ]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    balance = (len(y) / (2.0 * np.bincount(y, minlength=2)))[y].astype(np.float32)[:, None] / len(y)
    one_hot = np.eye(2, dtype=np.float32)[y]
    for step in range(1, EPOCHS + 1):
        _, slopes = gradients(parameters, forward, backward, share, one_hot, balance)
        slopes[0] += DECAY * parameters[0]
        for k, g in enumerate(slopes):
            a, v = moments[k]
            a += 0.1 * (g - a)
            v += 0.001 * (g * g - v)
            scale = np.sqrt(v / (1 - 0.999**step))
            parameters[k] = parameters[k] - RATE * (a / (1 - 0.9**step)) / (scale + DAMPING * np.sqrt(np.square(scale).mean()) + 1e-8)
    e, w, b = parameters
    gain = np.zeros(BUCKETS)
    gain[used] = e @ (w[:, 1] - w[:, 0])
    return Model(gain, float(b[1] - b[0]))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model of a bounded sample of the labelled documents of the folds that are not held out.

    docs: doc_id, text; labels: doc_id, toxic (1 or 0; other values teach nothing). Words are counted on the executors. Rows of
    one id teach each, equal rows once; null ids teach nothing. Of the sample, in the order of hashed ids, so many documents
    are learned from as have MOST_BYTES of text, four times `most` at most. No labels: everything scores 0.5.
    """
    rows = pick(labels, "doc_id", "toxic").where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).distinct()
    some = bounded(rows, F.col("toxic"), most)
    taken = pick(docs, "doc_id", "text").join(F.broadcast(some), "doc_id")  # at most about 2 * most pairs of numbers
    text = F.coalesce("text", F.lit(""))
    taken = taken.select("doc_id", F.col("toxic").cast("int").alias("toxic"), text.alias("text"), F.xxhash64("doc_id").alias("place"), F.xxhash64(text).alias("hash"), F.octet_length(text).cast("long").alias("size"))
    order = ["place", "doc_id", "hash", "toxic"]
    sizes = taken.select(*order, "size").distinct().orderBy(*order).limit(4 * most)
    before = F.sum("size").over(Window.orderBy(*order)) - F.col("size")  # at most 4 * most rows of numbers
    sizes = sizes.withColumn("before", before).where(F.col("before") < MOST_BYTES).select("doc_id", "hash", "toxic")
    taken = taken.join(F.broadcast(sizes), ["doc_id", "hash", "toxic"], "left_semi").dropDuplicates(["doc_id", "hash", "toxic"])

    def count(batches):
        for batch in batches:
            bags = [bag(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), batch.column("hash"), pa.array([x for x, _ in bags], pa.list_(pa.binary())), pa.array([n for _, n in bags], pa.list_(pa.int32()))],
                ["doc_id", "toxic", "hash", "words", "counts"],
            )

    bags = taken.select("doc_id", "toxic", "hash", "text").mapInArrow(count, "doc_id long, toxic int, hash long, words array<binary>, counts array<int>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("hash", "ascending")])
    if not bags.num_rows:
        return Model(np.zeros(BUCKETS), 0.0)
    rows = ((bags["words"][i].as_py(), bags["counts"][i].as_py()) for i in range(bags.num_rows))
    return fit(rows, bags["toxic"].to_pylist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1, for every whole text; null and empty texts score by the bias alone.

    Each row, repeated ones too, is scored on its own; no rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                ws = pieces(text)
                gains = list(map(known.get, ws))
                if None in gains:
                    now = {w: model.word(w) for w, x in zip(ws, gains, strict=True) if x is None}
                    gains = [x if x is not None else now[w] for w, x in zip(ws, gains, strict=True)]
                    if len(known) < MOST_WORDS:
                        known.update(now)
                z = SCALE * math.fsum(gains) / (len(ws) + PAD) + model.bias
                out.append(1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = pick(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, score double")
