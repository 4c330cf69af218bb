"""What a larger table must not change: whole jobs, and work that grows no faster than the rows."""

import datetime
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loreweave import catalog
from loreweave.functions.stem import stem, tokens, tokens_of
from loreweave.operators import blobs, compress, consolidate, search
from loreweave.plans import catalog_text, retrieve
from loreweave.sources.shared import cut


def test_merged_facts_go_through_each_list_once(spark):
    """The lists are computed once each, not once for each of their elements."""
    words = [f"w{i % 7000}" for i in range(20_000)]
    df = spark.createDataFrame([(" ".join(words[:3]), " ".join(words[3:]))], "a string, b string").select(compress.merged_facts(F.split("a", " "), F.split("b", " ")).alias("x"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 2
    assert df.first().x == words[:7000]


def test_stale_candidates_of_every_relation(spark, tmp_path):
    """A "placed" edge that a later copy closes counts like any other."""
    day = datetime.date(1996, 1, 1)
    spark.createDataFrame([(14, 1, "O", "1-URGENT", day), (1064, 1, "O", "1-URGENT", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "Customer#000000001", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert [tuple(r) for r in catalog.queries()["stale_candidates"](spark, str(tmp_path)).collect()] == [(4, 14)]


def test_similar_pairs_carry_terms_of_near_texts_alone(spark, monkeypatch):
    """Texts that share many words, but fewer than half, meet as ids and sketches; short and long ones, against brute force."""
    rng = random.Random(3)
    vocabulary = [f"term{i}" for i in range(3000)]
    sets = [set(rng.sample(vocabulary, n)) for n in [3] * 20 + [12] * 40 + [150] * 120 + [900] * 40]
    sets += [set(rng.sample(sorted(s), len(s) * 2 // 3 + 1)) | set(rng.sample(vocabulary, len(s) // 10)) for s in sets[::5]]
    m = spark.createDataFrame([(i, "fact", " ".join(sorted(s))) for i, s in enumerate(sets)], "memory_id long, kind string, summary string")
    kept = {}

    def cut(df, name="step", plain=consolidate.cut):
        kept[name] = plain(df, name)
        return kept[name]

    monkeypatch.setattr(consolidate, "cut", cut)
    got = {(r.a, r.b) for r in consolidate.similar_pairs(m).collect()}
    assert got == {(a, b) for b in range(len(sets)) for a in range(b) if sets[a] != sets[b] and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert 40 <= len(got) and kept["candidates"].count() <= 2 * len(got)


def test_words_are_counted_slice_by_slice():
    """A worker makes objects of some SLICE bytes of text at a time, whatever the batch; no row is lost."""
    texts = ["a" * 400_000, None, "", "b" * 400_000, "c" * 3_000_000, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["memory_id", "text"])
    parts = list(search.sliced([batch], "text"))
    assert [x.column("memory_id").to_pylist() for x in parts] == [[0, 1, 2, 3], [4], [5]]
    assert list(search.sliced([batch.slice(0, 0)], "text")) == []


def test_counted_over_several_slices(spark):
    texts = {i: " ".join(f"w{i} w{j % 7}" for j in range(60_000)) for i in range(6)} | {6: "", 7: None}
    df = spark.createDataFrame(list(texts.items()), "memory_id long, text string").coalesce(1)
    got = {r.memory_id: (r.length, {h.token: h.tf for h in r.hits}) for r in search.counted(df, None, False).collect()}
    want = {i: Counter((x or "").split()) for i, x in texts.items()}
    assert got == {i: (sum(c.values()), dict(c)) for i, c in want.items()}


def test_tokens_of_many_texts():
    """Texts are split as arrays, as tokens splits each; stems are those of wanted words alone."""
    texts = ["Café-Crème, X_y 9\u2014z", None, "", " ", "\x00a\x00 a", "Running  runs RAN\nran"]
    at, number, words = tokens_of(pa.array(texts, pa.string()))
    assert [[words[n] for i, n in zip(at, number) if i == k] for k in range(len(texts))] == [tokens(x) for x in texts]
    assert all(len(x) == 0 for x in tokens_of(pa.array([], pa.string())))


def test_stems_are_counted_over_several_slices(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abeilst", k=rng.randint(1, 6))) + rng.choice(["", "s", "ed", "ing", "ational", "fulness", "bly", "e", "ll", "é"]) for _ in range(3000)]
    texts = {i: " ".join(rng.choices(words, k=n)) for i, n in enumerate([120_000, 5, 120_000, 0, 300_000, 1])}
    df = spark.createDataFrame(list(texts.items()), "memory_id long, text string").coalesce(1)
    want = {i: Counter(map(stem, tokens(x))) for i, x in texts.items()}
    some = frozenset(rng.sample(sorted(want[0]), 200))
    for wanted in (None, some, frozenset()):
        got = {r.memory_id: (r.length, [(h.token, h.tf) for h in r.hits]) for r in search.counted(df, wanted).collect()}
        assert {i: (n, dict(h)) for i, (n, h) in got.items()} == {i: (sum(c.values()), {x: n for x, n in c.items() if wanted is None or x in wanted}) for i, c in want.items()}
        assert all(len(h) == len(dict(h)) for _, h in got.values())


def test_a_hop_without_questions_reads_no_text(spark, monkeypatch):
    """The second hop asks what the first did, so its texts are not gone through; the hops before count all of them."""
    kept = []

    def cut(df, name="step", plain=search.cut):
        out = plain(df, name)
        kept.extend([out.count()] if name == "index" else [])
        return out

    monkeypatch.setattr(search, "cut", cut)
    rows = catalog.queries()["multi_hop_search"](spark, "/root/testdata/sf0.001").count()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert kept == [n, n, 0] and rows > 0
    words = spark.createDataFrame([(1, "?!")], "query_id long, query string")
    m = spark.createDataFrame([(1, "p", "s", "a text", "", 5)], "memory_id long, project string, session_id string, summary string, tags string, created_at long")
    assert search.search_project(m, m, words, 5).collect() == [] and kept[3:] == [0]


def test_terms_are_found_within_words(spark):
    """What Held finds is what a text contains, beyond ASCII and with apostrophes too, and no text is shuffled for it."""
    rng = random.Random(5)
    letters = "abcäß日'1"
    terms = {"".join(rng.choices(letters, k=rng.randint(3, 5))) for _ in range(300)}
    texts = ["".join(rng.choices(letters + " .-\n\x00 _", k=rng.randint(0, 400))) for _ in range(200)]
    held = search.Held(terms)
    assert all(held.of(x) == sorted(t for t in terms if t in x) for x in [*texts, *texts])
    assert search.Held([]).of("a b") == [] and search.Held(["ab", "abc"]).of("x-xabcx") == ["ab", "abc"]
    m = spark.createDataFrame([(i, 10, "p", x) for i, x in enumerate(texts)], "memory_id long, created_at long, title string, summary string")
    q = spark.createDataFrame([(1, "abc äßa 11a")], "query_id long, query string")
    plan = search.chunk_parents(m, m, q, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "summary" not in plan[: plan.index("MapInArrow")]


def test_content_type_splits_a_text_once(spark):
    df = spark.createDataFrame([("diff --git\n+a",), ("a {b}",), (None,)], "x string").select(blobs.content_type(F.col("x")).alias("x"))
    assert [r.x for r in df.collect()] == ["diff", "code", "text"]
    assert df._jdf.queryExecution().analyzed().toString().count("split(") == 1


def test_blobs_are_packed_from_one_store(spark, monkeypatch):
    """Contents are hashed and typed once and dictionaries trained once; what a text takes without one comes from packing it."""
    kept = []
    monkeypatch.setattr(catalog_text, "cut", lambda df, name="step", plain=catalog_text.cut: (kept.append(name), plain(df, name))[1])
    df = catalog.queries()["blob_packing"](spark, "/root/testdata/sf0.001")
    assert kept == ["stored", "dictionaries", "packed"] and df.where("intact AND no_larger").count() == df.count() > 0


def test_blobs_go_slice_by_slice(spark):
    texts = ["x" * 300_000, None, "é", "", "y" * 3_000_000] * 3
    b = spark.createDataFrame([(hashlib.sha256((x or "").encode()).hexdigest(), x) for x in texts], "hash string, data string").coalesce(1)
    got = blobs.load(blobs.compressed(b)).select("hash", F.length("text").alias("n"), "intact").collect()
    assert sorted((r.hash, r.n, r.intact) for r in got) == sorted((hashlib.sha256((x or "").encode()).hexdigest(), len(x or ""), True) for x in texts)


def test_texts_stay_where_they_are(spark):
    """What was found, once written, goes to the texts: neither a context nor a reranker's terms shuffle all of them."""
    rng = random.Random(9)
    m = cut(spark.createDataFrame([(i, "".join(rng.choices("abcdefgh ", k=2000))) for i in range(2000)], "memory_id long, summary string"), "texts")
    found = cut(spark.createDataFrame([(1, 5, 0), (1, 7, 1)], "query_id long, memory_id long, rank0 long"), "found")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        q = spark.createDataFrame([(1, "abc")], "query_id long, query string")
        plan = retrieve.lexical_rerank(found.withColumn("score", F.lit(0.0)), q, m)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"BroadcastHashJoin.*LeftSemi", plan)
        assert sorted(r.memory_id for r in retrieve.context(found, m).collect()) == [5, 7]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_pairs_are_dealt_by_memories_not_by_terms(spark, monkeypatch):
    """A memory goes to a few groups, however many terms its prefix has; with more memories than a block has, all blocks meet."""
    hs = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    batch = pa.RecordBatch.from_arrays([pa.array(["fact"]), pa.array([7]), pa.array([0]), pa.array([hs])], ["kind", "memory_id", "block", "hs"])
    rows = [r for x in consolidate._dealt(batch, np.full(consolidate.BUCKETS, 9, np.uint8), 0.5) for r in x.to_pylist()]
    assert len(rows) <= 2 * consolidate.PARTS and {len(r["sketch"]) * 8 for r in rows} == {8 << 11, 8 << 10}
    assert sum(len(r["codes"]) for r in rows if r["level"] == 11) >= 1000
    rng = random.Random(5)
    sets = [set(rng.sample([f"term{i}" for i in range(60)], rng.choice([1, 2, 3, 7, 20, 40]))) for _ in range(90)]
    monkeypatch.setattr(consolidate, "MOST_ROWS", 4)
    m = spark.createDataFrame([(i, "fact", " ".join(sorted(s))) for i, s in enumerate(sets)], "memory_id long, kind string, summary string")
    for t in (0.3, 0.5, 0.8):
        got = {(r.a, r.b) for r in consolidate.similar_pairs(m, t).collect()}
        firsts = [i for i, s in enumerate(sets) if s not in sets[:i]]
        assert got == {(a, b) for b in firsts for a in firsts if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_events_of_all_dated_memories(spark, monkeypatch):
    """An old memory is found behind any number of newer dated ones, whichever side is sent to the other; ties and dates are those of all."""
    rows = [(i, 1000 + i, "alpha beta gamma" if i == 3 else "alpha delta" if i % 2 else "alpha", None) for i in range(700)]
    m = spark.createDataFrame(rows, "memory_id long, created_at long, summary string, tags string")
    meta = spark.createDataFrame([(i, "2020-01-01" if i else "2021-05-05", "fact") for i in range(700)], "memory_id long, event_time string, kind string")
    q = spark.createDataFrame([(1, "alpha gamma beta in 2021"), (2, "delta"), (3, "of the in"), (4, "alpha")], "query_id long, query string")
    find = lambda **pool: {(r.query_id, r.rank0): (r.memory_id, round(r.score, 6)) for r in search.temporal_events(m, meta, q, 3, **pool).collect()}
    got = find()
    # alpha, beta and gamma of four terms, a fact, a whole date, three points for one year apart; twice the quality, since dates disagree.
    assert got[1, 0] == (3, 3 * 10 + 3 * 0.75 + 4 + 1 + 3 + 2 * (3 * 2 + 2 * 0.75 + 4))
    assert got[1, 1][0] == 0 and [got[2, i] for i in range(3)] == [(699, 18.0), (697, 18.0), (695, 18.0)]
    assert [got[4, i] for i in range(3)] == [(699, 18.0 + 2 * 8), (698, 18.0 + 2 * 8), (697, 18.0 + 2 * 8)] and len(got) == 9
    monkeypatch.setattr(search, "MOST_DATED", 0)
    assert find() == got
    assert (1, 0) in find(pool=512) and find(pool=512)[1, 0][0] == 699


def test_greedy_groups_by_blocks(spark, monkeypatch):
    """Groups are the same in however many blocks memories meet, and terms are written once for members and pairs."""
    rng = random.Random(11)
    rows = [(i, "fact", rng.randint(1, 9), " ".join(rng.sample([f"term{j}" for j in range(20)], rng.choice([2, 3, 8])))) for i in range(80)]
    m = spark.createDataFrame(rows, "memory_id long, kind string, created_at long, summary string")
    find = lambda: sorted((r.leader, r.memory_ids) for r in consolidate.greedy_groups(m).collect())
    want, kept = find(), []
    monkeypatch.setattr(consolidate, "MOST_ROWS", 9)
    monkeypatch.setattr(consolidate, "cut", lambda df, name="step", plain=consolidate.cut: (kept.append(name), plain(df, name))[1])
    assert find() == want and len(want) > 3 and kept.count("terms") == 1
