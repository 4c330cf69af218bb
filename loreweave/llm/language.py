"""Language ID by rank-order profiles: out-of-place distance between the most frequent n-grams of text and language."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import held_out, pick
from loreweave.llm.samples import bounded

#: Labelled documents of each language that profiles are learned from, at most about so many.
MOST_LABELLED = 2000
#: n-grams in a profile, and their lengths.
PROFILE = 300
LENGTHS = (1, 2, 3)
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point, one more than itself if it is a letter, else 1."""
    return np.array([c + 1 if chr(c).isalpha() else 1 for c in range(0x110000)], np.int64)


def ngrams(text: str | None) -> np.ndarray:
    """Codes of the n-grams of the letters of the lower-cased text; 1 stands for what parts words."""
    if not text:
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[points]
    c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
    if len(c) < 2:
        return np.empty(0, np.int64)
    one, two = c[c != 1], c[:-1] << 21 | c[1:]
    return np.concatenate([one, two, two[:-1] << 21 | c[2:]])


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order; ties go by the code."""
    found, n = np.unique(codes, return_counts=True)
    if len(found) > 4 * most:  # only those that can be among the first
        least = np.partition(n, len(n) - most)[len(n) - most]
        found, n = found[n >= least], n[n >= least]
    return found[np.argsort(-n, kind="stable")][:most]


def learn(docs: DataFrame, most: int = MOST_LABELLED, profile: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language, from a bounded sample of documents with a non-null lang that are not held out.

    docs: doc_id, text, lang. Counts are summed on the executors; only the profiles come to the driver. Rows with null or
    repeated ids are documents each; equal rows are in the sample together or not. No rows with a language: no profiles.
    """
    rows = pick(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id")))
    some = bounded(rows, F.col("lang"), most, of=("doc_id", "text"))

    def count(batches):
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counts = some.select("text", "lang").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "code").collect()):
        out.setdefault(r[0], []).append(r[2])
    return out


class Identifier:
    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.names, self.most = sorted(profiles), most
        self.profiles = []
        for name in self.names:
            codes = np.array(profiles[name], np.int64)
            order = np.argsort(codes)
            self.profiles.append((codes[order], order))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The nearest language and its share of the closeness to all; ties go by name. No letter or no profile: unknown."""
        codes = ngrams(text)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        doc = ranked(codes, self.most)
        close = []
        for known, rank in self.profiles:
            at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
            out_of_place = np.where(known[at] == doc, np.minimum(np.abs(rank[at] - np.arange(len(doc))), self.most), self.most)
            close.append(1.0 - float(out_of_place.sum()) / (self.most * len(doc)))
        best = int(np.argmax(close))
        return self.names[best], close[best] / sum(close) if sum(close) else 0.0


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for every whole text; each row, repeated ones too, is judged on its own.

    Null texts and texts without a letter are UNKNOWN with 0, as is everything without profiles. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        identify = Identifier(shared.value)
        for batch in batches:
            found = [identify(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = pick(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
