"""The stored vector index against search by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import ann, knn

DIM = 24


def clustered(spark, n, seed, first=0):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(1).normal(size=(40, DIM))
    x = middles[rng.integers(0, 40, n)] + rng.normal(size=(n, DIM)) * 0.35
    return spark.createDataFrame([(first + i, x[i].tolist(), "rare" if i % 97 == 0 else f"p{i % 3}") for i in range(n)], "memory_id long, embedding array<float>, project string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    v = clustered(spark, 6000, 2).cache()
    path = str(tmp_path_factory.mktemp("ann") / "x")
    ann.build(v, path, cells=60)
    return v, path


def asked_of(v):
    return v.where("memory_id % 100 = 0").select(F.col("memory_id").alias("query_id"), "embedding")


def rows(df):
    return {(r.query_id, r.rank0): r.memory_id for r in df.collect()}


def test_recall(spark, index):
    v, path = index
    want = {(r.query_id, r.memory_id) for r in knn.nearest(v, asked_of(v), 10).collect()}
    for probes, least in ((2, 0.6), (ann.PROBES, 0.95)):
        found = ann.search(spark, path, asked_of(v), 10, probes=probes).collect()
        assert len(found) == 600 and len(want & {(r.query_id, r.memory_id) for r in found}) >= least * len(want)
        sure = [r for r in found if r.certain]
        assert all((r.query_id, r.memory_id) in want for r in sure)
    assert ann._vectors(spark, path).count() == 6000 and spark.read.parquet(f"{path}/centres").count() == 60


def test_certain_hits_are_those_of_brute_force(spark, index):
    v, path = index
    exact = ann.search(spark, path, asked_of(v), 10, probes=3, most_rounds=None)
    assert rows(exact) == rows(knn.nearest(v, asked_of(v), 10)) and exact.where("NOT certain").count() == 0
    some = v.where("project = 'rare'")
    assert rows(ann.search(spark, path, asked_of(v), 5, where=F.col("project") == "rare", probes=3, most_rounds=None)) == rows(knn.nearest(some, asked_of(v), 5))


def test_a_filter_leaves_no_query_short(spark, index):
    v, path = index
    found = ann.search(spark, path, asked_of(v), 5, where=F.col("project") == "rare", probes=1)
    assert found.groupBy("query_id").count().where("count < 5").count() == 0
    assert found.join(v.where("project <> 'rare'"), "memory_id").count() == 0
    none = ann.search(spark, path, asked_of(v), 5, where=F.col("project") == "nowhere", probes=1)
    assert none.count() == 0


def test_blocks_and_additions(spark, index, tmp_path, monkeypatch):
    v, _ = index
    path = str(tmp_path / "x")
    ann.build(v.where("memory_id < 3000"), path, cells=20)
    ann.add(v.where("memory_id >= 3000"), path)
    assert ann.newest(spark, path) == 5999
    monkeypatch.setattr(ann, "MOST_QUERIES", 7)
    q = asked_of(v).where("query_id < 2000")
    assert rows(ann.search(spark, path, q, 4, most_rounds=None)) == rows(knn.nearest(v, q, 4))


def test_edges(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0])], "memory_id long, embedding array<float>")
    path = str(tmp_path / "x")
    assert not ann.exists(spark, path)
    ann.build(v, path)
    q = spark.createDataFrame([(1, [3.0, 0.0]), (9, [0.0, 0.0])], "query_id long, embedding array<float>")
    found = ann.search(spark, path, q, 2, include_self=True)
    assert rows(found) == {(1, 0): 1, (1, 1): 2, (9, 0): 1, (9, 1): 2} and found.where("NOT certain").count() == 0
    assert ann.search(spark, path, q.limit(0), 2).count() == 0
    empty = str(tmp_path / "y")
    ann.build(v.limit(0), empty)
    assert ann.exists(spark, empty) and ann.newest(spark, empty) is None and ann.search(spark, empty, q, 2).count() == 0
