"""A stored vector index: unit vectors in cells around learned centres, of which a query reads the nearest cells alone.

    <path>/centres/             cell, centre: learned once from a bounded sample
    <path>/vectors/cell=C/      memory_id, embedding (unit length) and the columns that searches filter by
    <path>/radii/               cell, radius: the greatest angle between the centre and a vector of the cell, one row per write

Every vector is in the index; only the centres come from a sample. A search goes through more and more cells until no unread
cell can hold a better hit, which angles and radii tell, or until it has read as many as it may.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.search import in_blocks, top
from loreweave.sources.shared import cut

#: Vectors a cell should have, cells at most, sampled vectors a cell, and rounds of k-means.
PER_CELL, MOST_CELLS, SAMPLED, ROUNDS = 2000, 4096, 32, 12
#: Cells of a query in the first round; each further round takes twice as many.
PROBES = 8
#: Queries that are sent to every task at once.
MOST_QUERIES = 4096
#: Angles are compared with so much room for rounding.
ROOM = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as unit vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return _unit(values.reshape(len(column), -1))


def _groups(cells: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, starts[1:]), strict=True))


def learn(vectors: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centres by k-means on the sphere, from at most SAMPLED vectors a cell, chosen by a hash of the id.

    cells: as many as give each PER_CELL vectors, MOST_CELLS at most. A few vectors make one cell, which a search reads whole.
    """
    n = vectors.count()
    cells = max(1, min(MOST_CELLS, n // PER_CELL)) if cells is None else max(1, min(cells, n))
    some = vectors if n <= SAMPLED * cells else vectors.where(F.pmod(F.xxhash64("memory_id", F.lit(seed)), F.lit(n)) < SAMPLED * cells)
    rows = some.select("embedding").limit(2 * SAMPLED * cells).collect()  # about SAMPLED * cells
    if not rows:
        return np.zeros((0, 0))
    x = _unit(np.array([r[0] for r in rows], float))
    x = x[np.lexsort(x.T)]
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:cells]]
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centres.T, axis=1)
        for c, at in _groups(nearest):
            total = x[at].sum(axis=0)
            if np.linalg.norm(total) > 0:
                centres[c] = total / np.linalg.norm(total)
    return centres


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> None:
    """Writes an index of vectors (memory_id, embedding, and columns to filter by), in place of one that is there.

    Rows without a vector are left out. All vectors have one length; zero vectors are near nothing.
    """
    vectors = vectors.where("embedding IS NOT NULL")
    centres = learn(vectors, cells, seed)
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    _write(vectors, path, centres, "overwrite")


def add(vectors: DataFrame, path: str) -> None:
    """Adds vectors that the index doesn't have to the cells that it has."""
    _write(vectors.where("embedding IS NOT NULL"), path, centres_of(vectors.sparkSession, path), "append")


def centres_of(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST_CELLS
    return np.array([r.centre for r in rows], float)


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(f"{path}/centres")
    except AnalysisException:
        return False
    return True


def newest(spark: SparkSession, path: str) -> int | None:
    """The largest id in the index."""
    return _vectors(spark, path).agg(F.max("memory_id")).first()[0]


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path}/vectors")
    except AnalysisException:  # an index of no vectors
        return spark.createDataFrame([], "memory_id long, embedding array<float>, cell int")


def _write(vectors: DataFrame, path: str, centres: np.ndarray, mode: str) -> None:
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    others = [c for c in vectors.columns if c != "embedding"]

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            near = x @ shared.value.T
            cell = np.argmax(near, axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), flat, pa.array(cell.astype(np.int32)), pa.array(angle)], [*others, "embedding", "cell", "_angle"])

    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in others)
    rows = cut(vectors.select(*others, "embedding").mapInArrow(assign, f"{kinds}, embedding array<float>, cell int, _angle double"), "assigned")
    rows.drop("_angle").hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")
    rows.groupBy("cell").agg(F.max("_angle").alias("radius")).coalesce(1).write.mode(mode).parquet(f"{path}/radii")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, where: Column | None = None, probes: int = PROBES, most_rounds: int | None = 1, include_self: bool = False) -> DataFrame:
    """(query_id, memory_id, similarity, rank0, certain): the k nearest of each query (query_id, embedding) by cosine, ties by id.

    where: a condition on the index's columns; it holds of all hits, and a query goes on to further cells while it has fewer than k.
    A round reads `probes` cells of each query, twice as many in the next. Without most_rounds all hits are certain: rounds
    go on until no unread cell can hold a nearer vector. certain: whether that is so. Queries pass in blocks of MOST_QUERIES.
    """
    centres = centres_of(spark, path)
    radii = np.full(len(centres), -1.0)
    for r in spark.read.parquet(f"{path}/radii").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # at most MOST_CELLS
        radii[r.cell] = r.radius
    vectors = _vectors(spark, path)
    vectors = vectors if where is None else vectors.where(where)
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "memory_id": vectors.schema["memory_id"].dataType.simpleString()}
    schema = f"query_id {kinds['query_id']}, memory_id {kinds['memory_id']}, similarity double"

    def block(rows: list) -> DataFrame:
        if not rows or not len(centres):
            return spark.createDataFrame([], f"{schema}, rank0 long, certain boolean")
        ids = [r[0] for r in rows]
        q = _unit(np.array([r[1] for r in rows], float))
        angles = np.arccos(np.clip(q @ centres.T, -1, 1))
        #: The nearest that a vector of a cell can be; a cell without vectors is never read.
        bound = np.where(radii < 0, -2.0, np.cos(np.maximum(angles - radii - ROOM, 0)))
        order = np.argsort(angles, axis=1, kind="stable")
        live = [[int(c) for c in row if radii[c] >= 0] for row in order]
        read = [0] * len(q)
        going, hits, step, number = list(range(len(q))), None, probes, 0
        while going:
            ask: dict[int, list[int]] = {}
            for i in going:
                for c in live[i][read[i] : read[i] + step]:
                    ask.setdefault(c, []).append(i)
                read[i] = min(read[i] + step, len(live[i]))
            new = cut(_scan(vectors.where(F.col("cell").isin(list(ask))), q, ids, ask, k + 1, schema), "scan")
            new = new if include_self else new.where("query_id <> memory_id")
            hits = cut(top(new if hits is None else hits.drop("rank0").unionByName(new), k, F.desc(F.round("similarity", 9)), "memory_id"), "hits")
            step, number = 2 * step, number + 1
            last = {r[0]: r[1] for r in hits.where(F.col("rank0") == k - 1).select("query_id", "similarity").collect()}  # a row a query of the block
            best = [max((bound[i][c] for c in live[i][read[i] :]), default=-3.0) for i in range(len(q))]
            going = [i for i in going if read[i] < len(live[i]) and not last.get(ids[i], -2.0) > best[i] + 1e-9]
            if most_rounds is not None and number >= most_rounds:
                short = {ids[i] for i in going} - set(last)
                going = [i for i in going if ids[i] in short]  # the filter left too few: on with these
        sure = [(ids[i], bool(read[i] == len(live[i]) or last.get(ids[i], -2.0) > best[i] + 1e-9)) for i in range(len(q))]
        return hits.join(F.broadcast(spark.createDataFrame(sure, f"query_id {kinds['query_id']}, certain boolean")), "query_id")  # MOST_QUERIES rows

    return in_blocks(queries.select("query_id", "embedding"), MOST_QUERIES, block).select("query_id", "memory_id", "similarity", "rank0", "certain")


def _scan(vectors: DataFrame, q: np.ndarray, ids: list, ask: dict[int, list[int]], keep: int, schema: str) -> DataFrame:
    """What each batch of the cells has for the queries that ask for them, the best `keep` of each."""
    shared = vectors.sparkSession.sparkContext.broadcast((q, ids, ask))

    def run(batches):
        q, ids, ask = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, memory = _matrix(batch.column("embedding")), batch.column("memory_id").to_numpy(zero_copy_only=False)
            names, found, values = [], [], []
            for c, rows in _groups(batch.column("cell").to_numpy(zero_copy_only=False)):
                who = np.array(ask.get(c, []), int)
                s = q[who] @ x[rows].T
                n = min(keep, len(rows))
                for i, line in zip(who, s, strict=True):
                    at = np.flatnonzero(line >= np.partition(line, len(rows) - n)[len(rows) - n] - 1e-9)
                    names += [ids[i]] * len(at)
                    found.append(memory[rows[at]])
                    values.append(line[at])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate(found)), pa.array(np.concatenate(values))], ["query_id", "memory_id", "similarity"])

    return vectors.select("memory_id", "embedding", "cell").mapInArrow(run, schema)
