from collections import defaultdict

import numpy as np

import corpus_pipeline
from loreweave.llm import decontaminate, quality_classifier
from tests.llm.test_simhash import plain as components
from tests.llm.test_suffix_dedup import plain as repeats
from tests.llm.test_tokens import library


def test_stages_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stage = [f for _, f in corpus_pipeline.STAGES]

    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.kept for r in quality_classifier.score(docs, quality_classifier.learn(docs)).collect()}
    docs = stage[0](spark, docs, sf).cache()
    assert docs.columns == columns and {r.doc_id: r for r in docs.collect()} == {i: r for i, r in rows.items() if scores[i]}

    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    docs = stage[1](spark, docs, sf).cache()
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted({c for _, _, c in components(rows)})

    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    docs = stage[2](spark, docs, sf).cache()
    kept = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and sorted(kept) == [i for i, _ in rows]
    for (i, text), (size, removed, _, _) in zip(rows, repeats(rows), strict=True):
        now = len(kept[i].text.encode())
        assert kept[i].n_chars == len(kept[i].text) and (kept[i].text == text if not removed else size - removed - 6 <= now <= size - removed)

    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    windows = {tuple(ws[i : i + min(13, len(ws))]) for ws in (decontaminate.words(r.text) for r in items) if ws for i in range(max(1, len(ws) - 12))}
    sizes = {len(w) for w in windows}

    def left(text):
        """The words that stay: None if the text is contaminated, else without hit ones, as often as any are hit."""
        ws, first = decontaminate.words(text), True
        while hit := {i + k for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for k in range(n)}:
            if first and 20 * len(hit) >= len(ws):
                return None
            ws, first = [w for i, w in enumerate(ws) if i not in hit], False
        return ws

    before = {r.doc_id: r for r in docs.collect()}
    docs = stage[3](spark, docs, sf).cache()
    want = {i: ws for i, r in before.items() if (ws := left(r.text)) is not None}
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and {i: decontaminate.words(r.text) for i, r in after.items()} == want
    same = [i for i, ws in want.items() if ws == decontaminate.words(before[i].text)]
    assert len(same) < len(before) and all(after[i] == before[i] for i in same) and all(r.n_chars == len(r.text) for r in after.values())

    whole = defaultdict(list)
    for r in stage[4](spark, docs, sf).collect():
        whole[r.doc_id].append((r.start, bytes(r.ids)))
    ids = library("byte_bpe_50k.json")
    assert {i: b"".join(x for _, x in sorted(parts)) for i, parts in whole.items()} == {r.doc_id: np.array([*ids(r.text), 1], "<u4").tobytes() for r in docs.collect()}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50


def test_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf)
    assert docs.columns == odd_docs.columns and {r.doc_id for r in docs.collect()} >= {None, 1, 3, 8}
