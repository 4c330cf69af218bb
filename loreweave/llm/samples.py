"""Bounded samples of labelled rows, chosen by a hash of the id, for the models that learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 40


def place(*of: str, seed: int) -> Column:
    """A number below SPAN from the hash of a row's columns."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in of], F.lit(seed)), F.lit(SPAN))


def threshold(n: int, least: int, most: int) -> int:
    """Of n rows about `most` have a place below it, and at least those with the least place, however many rows are equal."""
    return SPAN if n <= most else max(SPAN * most // n, least + 1)


def bounded(rows: DataFrame, by: Column, most: int, of: tuple[str, ...] = ("doc_id",), seed: int = 7) -> DataFrame:
    """About `most` rows of each value of `by`, all where there are fewer: those whose hashed columns `of` are below a threshold.

    The values of `by` are few (labels, languages); their counts are all that is collected. Rows with equal columns `of`, null
    ones too, are taken together or not at all; those with the least hash always are.
    """
    hashed = place(*of, seed=seed)
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy(by.cast("string").alias("v")).agg(F.count("*"), F.min(hashed)).collect() if r[0] is not None}
    limit = F.lit(0)
    for value, (n, least) in sorted(counts.items()):
        limit = F.when(by.cast("string") == value, F.lit(threshold(n, least, most))).otherwise(limit)
    return rows.where(hashed < limit)
