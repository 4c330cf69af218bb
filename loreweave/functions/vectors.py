"""Vectors as arrays of floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def folding_embedder(dim: int):
    """A deterministic embedder: bytes are added up by place modulo dim, and the sum is normalised."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = []
            for t in batch:
                raw = np.frombuffer((t or "").encode(), np.uint8)
                v = np.bincount(np.arange(len(raw)) % dim, weights=raw, minlength=dim)
                n = np.sqrt((v * v).sum())
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pd.Series(out)

    return embed


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode(blobs: pd.Series) -> pd.Series:
    """Vectors from little-endian 32-bit floats; a broken length gives null."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())


@F.pandas_udf(T.BinaryType())
def encode(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())
