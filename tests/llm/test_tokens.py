import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loreweave.llm import orc_ids, packing, queries
from loreweave.llm.tokens import Encoder

VOCABULARIES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ENCODERS = {name: Encoder(public_tokenizers.path(name), leading) for name, leading in VOCABULARIES.items()}


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", VOCABULARIES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r.,'ab dSTré 　́Σς日İ1²\x00"), st.characters(codec="utf-8")), max_size=30), max_size=6))
def test_like_the_library(name, texts):
    ids = library(name)
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODERS[name].encode(texts)] == [ids(x) for x in texts]


def test_strings_of_special_tokens():
    for name, leading in VOCABULARIES.items():
        plain, ordinary = Tokenizer.from_file(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        ordinary.encode_special_tokens = True
        added = [x.content for x in plain.get_added_tokens_decoder().values()]
        assert added
        texts = [t.replace("X", x) for x in added for t in ("hello X there", "X", "aXb\nX X", "a " * 2000 + "X.", "<" + "X"[:-1], "XX")] + [x.upper() for x in added] + [x[:-1] for x in added]
        for t, e in ((plain, ENCODERS[name]), (ordinary, Encoder(public_tokenizers.path(name), leading, ordinary=True))):
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_whole_windows_alone():
    assert packing.windows([]) == []
    assert packing.pack_group([2048]) == [(0, 0, 2048, 0, 0)]
    assert packing.pack_group([4096, 2048]) == [(0, 0, 2048, 0, 0), (0, 2048, 2048, 1, 0), (1, 0, 2048, 2, 0)]
    assert packing.pack_group([]) == []


def test_packing(spark, sf, odd_docs, no_docs):
    ids = library("byte_bpe_50k.json")
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
        whole, windows = defaultdict(list), defaultdict(list)
        for r in rows:
            whole[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens))
            windows[r.sequence_id].append((r.offset, r.length))
        for doc in docs.collect():
            want = np.array([*ids(doc.text), 1], "<u4").tobytes()
            parts = sorted(whole.pop(doc.doc_id))
            assert b"".join(x[2] for x in parts) == want and all(4 * x[3] == len(want) for x in parts)
            assert [x[0] for x in parts] == [sum(y[1] for y in parts[:i]) for i in range(len(parts))]
        assert not whole
        for w in windows.values():
            w.sort()
            assert [x[0] for x in w] == [sum(y[1] for y in w[:i]) for i in range(len(w))] and sum(x[1] for x in w) <= 2048
    assert packing.pack(no_docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_little_padding(spark):
    rows = queries.op6_packing(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.length for r in rows) >= 0.985 * 2048 * len({r.sequence_id for r in rows})


def test_orc_ids(spark, sf, odd_docs, no_docs, tmp_path):
    ids = library("word_bpe_49k.json")
    for i, docs in enumerate((spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, no_docs)):
        orc_ids.write(docs, f"{tmp_path}/{i}", public_tokenizers.path("word_bpe_49k.json"))
        got = sorted((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in orc_ids.digests(spark, f"{tmp_path}/{i}").collect())
        at, want = 0, []
        for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, len(r.text or ""))):
            x = np.array([*ids(r.text), 2], "<u4")
            want.append((r.doc_id is not None, r.doc_id, at, len(x), zlib.crc32(x)))
            at += len(x)
        assert got == want


def test_a_search_by_id_is_pushed_to_the_files(spark, sf, tmp_path):
    orc_ids.write(spark.read.parquet(f"{sf}/documents.parquet"), f"{tmp_path}/x", public_tokenizers.path("word_bpe_49k.json"))
    one = orc_ids.read(spark, f"{tmp_path}/x").where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString() and one.count() == 1
