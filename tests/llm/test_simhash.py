from pyspark.sql import functions as F
import xxhash

from loreweave.llm import simhash
from loreweave.operators import components


def plain_fingerprint(text):
    ws = (text or "").encode().translate(simhash.LOWER).split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, _) in enumerate(rows):
        for m in range(n):
            if (fps[n] ^ fps[m]).bit_count() <= 4:
                a, b = sorted((root(i), root(rows[m][0])))
                up[b] = a
    return sorted((i, fp, root(i)) for (i, _), fp in zip(rows, fps))


def test_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((r[0], r[1] % 2**64, r[2]) for r in simhash.near_duplicates(docs).collect())
    assert got == plain(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    ids = {r[0]: r[2] for r in got}
    assert ids[1] == ids[2] == ids[7] == 1 and ids[3] == ids[4] == ids[6] == 3
    assert simhash.near_duplicates(no_docs).collect() == []
    assert sorted(r[0] for r in simhash.one_of_each(odd_docs.where("doc_id < 5")).collect()) == [1, 3]


def test_dense_group_is_one_component():
    import numpy as np

    fp = np.array([1 << i for i in range(64)] + [0], np.uint64)
    forest = simhash._forest(fp, np.arange(65, dtype=np.int64) + 7)
    assert len(forest) == 64 and {b for _, b in forest} == {7}


def test_components_of_a_path(spark):
    links = spark.range(200).select((F.col("id") * 7 % 200).alias("a"), ((F.col("id") + 1) * 7 % 200).alias("b")).where("a <> 0 and b <> 0 and a <> 100 and b <> 100")
    got = {r[0]: r[1] for r in components.components(links).collect()}
    assert len(got) == 198 and len(set(got.values())) == 2
