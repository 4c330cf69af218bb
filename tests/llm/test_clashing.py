"""Extra columns whose names an operator uses change nothing and stay as they are."""

import corpus_pipeline
import public_tokenizers
from tests.llm.conftest import CLASHING
from loreweave.llm import chat, decontaminate, language, orc_ids, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity


def rows(df, without=()):
    at = [i for i, c in enumerate(df.columns) if c not in without]
    return sorted(str([r[i] for i in at]) for r in df.collect())


def test_operators(spark, sf, odd_docs, clashing_docs):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0)], "doc_id long, toxic int")
    for operator in (
        simhash.near_duplicates,
        suffix_dedup.repeated_spans,
        lambda d: language.predict(d, language.learn(d)),
        lambda d: toxicity.score(d, toxicity.learn(d, labels)),
        lambda d: quality_classifier.score(d, quality_classifier.learn(d)),
        lambda d: decontaminate.find_spans(d, benchmark),
        lambda d: packing.pack(d.coalesce(1), public_tokenizers.path("byte_bpe_50k.json")),
    ):
        assert rows(operator(clashing_docs)) == rows(operator(odd_docs))


def test_rules_and_ids(clashing_docs, odd_docs, tmp_path):
    got, want = quality_rules.apply_rules(clashing_docs), quality_rules.apply_rules(odd_docs)
    assert got.columns[: len(clashing_docs.columns)] == clashing_docs.columns and got.columns[len(clashing_docs.columns) :] == want.columns[len(odd_docs.columns) :]
    assert rows(got, CLASHING) == rows(want) and rows(got, set(want.columns)) == rows(clashing_docs, set(odd_docs.columns))
    replaced = quality_rules.measure(odd_docs.toDF(*["n_words" if c == "fp" else c for c in odd_docs.columns]))
    assert replaced.columns == [c for c in odd_docs.columns if c != "fp"] + list(quality_rules.MEASURES)
    for i, d in enumerate((clashing_docs, odd_docs)):
        orc_ids.write(d, f"{tmp_path}/{i}", public_tokenizers.path("word_bpe_49k.json"))
    assert rows(orc_ids.digests(clashing_docs.sparkSession, f"{tmp_path}/0")) == rows(orc_ids.digests(odd_docs.sparkSession, f"{tmp_path}/1"))


def test_stages_keep_the_values(spark, sf, odd_docs, clashing_docs):
    own = set(odd_docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, clashing_docs, sf), stage(spark, odd_docs, sf)
        assert got.columns == clashing_docs.columns, name
        assert rows(got, set(got.columns) - own) == rows(want), name
        left = {tuple(r[i] for i, c in enumerate(got.columns) if c not in own) for r in got.collect()}
        before = {tuple(r[i] for i, c in enumerate(got.columns) if c not in own) for r in clashing_docs.collect()}
        assert left <= before, name


def test_layouts_with_extra_columns(spark):
    said = [(1, "user", "q"), (1, "assistant", "a")]
    messages, shared = "array<struct<role:string,content:string,name:string>>", "array<struct<from:string,value:string>>"
    m, s = [("user", "q", None), ("assistant", "a", None)], [("human", "q"), ("gpt", "a")]
    for row, schema in (
        ((1, "q", "", "a", "whole"), "conv_id long, instruction string, input string, output string, text string"),
        ((1, "q", "a", "whole"), "conv_id long, instruction string, output string, text string"),
        ((1, "other", m), f"conv_id long, prompt string, messages {messages}"),
        ((1, "other", "reply", m), f"conv_id long, prompt string, response string, messages {messages}"),
        ((1, s, "other", "reply"), f"conv_id long, conversations {shared}, prompt string, response string"),
        ((1, "q", "a", "x", 0, "user"), "conv_id long, prompt string, response string, Prompt string, turn int, role string"),
    ):
        t = spark.createDataFrame([row], schema)
        assert [(r.conv_id, r.role, r.text) for r in chat.canonical_turns(t).orderBy("turn").collect()] == said, schema
    t = spark.createDataFrame([(1, 0, "user", "q", "p", "r"), (1, 1, "assistant", "a", "p", "r")], "conv_id long, turn int, role string, text string, prompt string, response string")
    assert [(r.conv_id, r.role, r.text) for r in chat.canonical_turns(t).orderBy("turn").collect()] == said
