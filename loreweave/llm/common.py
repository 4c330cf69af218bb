"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources.shared import cut, discard, scratch
from loreweave.sources.views import base

__all__ = ["by_place", "cut", "discard", "held", "held_out", "parallelism", "pick", "release", "scratch", "table"]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, matched with their exact case.

    Other columns, also such as differ in case alone or clash with names an operator uses, are left out.
    """
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{at[n]}").alias(n) for n in names])


def by_place(df: DataFrame, *own: str) -> DataFrame:
    """df with the columns `own` under their names (exact case) and the others under names of their places.

    So an operator's names clash with none; toDF gives back the names of df.
    """
    return df.toDF(*[c if c in own and df.columns.index(c) == i else f"_c{i}" for i, c in enumerate(df.columns)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return base(spark, sf_dir, name)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing at a time, so another makes room first."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Gives back what this worker holds and what its allocator keeps: Spark hands workers from stage to stage."""
    _held.clear()
    gc.collect()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def parallelism(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id's decimal text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
