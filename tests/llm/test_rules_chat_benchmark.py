import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from loreweave.llm import chat, decontaminate, quality_rules
from loreweave.llm.common import cut

SPECIAL = ["<|im_end|>\n<|im_start|>assistant\nhi", "a & b &amp; &lt;| <|x", "&#10;", "", "line\n\nline\n", "<", "|", "&", "<|", None]


def test_rules_on_odd_rows(odd_docs, no_docs):
    got = quality_rules.apply_rules(odd_docs)
    assert got.count() == odd_docs.count() and quality_rules.apply_rules(no_docs).collect() == []
    by = {r.doc_id: r for r in got.collect()}
    assert by[4].n_words == by[3].n_words == by[6].n_words == 0 and by[4].base_failed and not by[4].kept
    assert by[5].n_words == 30_000 and by[1].n_repeat_words == by[1].n_words


def test_repeat_words_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        ws = text.split()
        windows = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
        assert got[i] == len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)})


def test_turns_come_back(spark):
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "sys\ntem<|", None]), SPECIAL[(c + t) % len(SPECIAL)]) for c in range(12) for t in range(c % 5 + 1)]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    out = chat.format_chat(turns).withColumns({"turns": chat.parse_chat(F.col("formatted")), "loss": chat.loss_text(F.col("segments"))})
    want = {}
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role or "", text or ""))
    for r in out.collect():
        assert [tuple(x) for x in r.turns] == want[r.conv_id]
        assert r.loss == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted


def test_layouts(spark):
    want = [(1, "user", "q"), (1, "assistant", "a")]
    tables = [
        spark.createDataFrame([(1, "q", "a", 3)], "conv_id long, prompt string, response string, extra int"),
        spark.createDataFrame([(1, "q", "", "a")], "conv_id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role:string,content:string>>"),
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from:string,value:string>>"),
    ]
    for t in tables:
        assert [(r.conv_id, r.role, r.text) for r in chat.canonical_turns(t).orderBy("turn").collect()] == want
    assert chat.canonical_turns(*tables).count() == 8
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))
    assert chat.format_chat(chat.canonical_turns(tables[0].limit(0))).collect() == []


def test_spans_like_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choice("abcdé") for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 12, 13, 20, 40]))) for i in range(25)] + [(90, None), (3, make(15))]
    docs = [(i, ", ".join([make(rng.randint(0, 9)), rng.choice(items)[1] or "", make(3)]).upper()) for i in range(150)] + [(999, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, text in items:
        ws = decontaminate.words(text)
        for k in range(max(1, len(ws) - 12)) if ws else ():
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(str(i))
    for group_bytes in (10**6, 200):
        got = {r.doc_id: r for r in decontaminate.judged(decontaminate.find_spans(d, b, group_bytes=group_bytes)).collect()}
        for i, text in docs:
            ws = decontaminate.words(text)
            hit, names = set(), set()
            for w, of in windows.items():
                for k in range(len(ws) - len(w) + 1):
                    if tuple(ws[k : k + len(w)]) == w:
                        hit |= set(range(k, k + len(w)))
                        names |= of
            r = got[i]
            assert (r.n_words, r.n_hit, r.item_ids) == (len(ws), len(hit), sorted(names))
            assert {k for s in r.spans for k in range(s.start, s.end)} == hit


def test_cut_spans():
    assert decontaminate.cut_spans("One, two three. Four", [(1, 3)]).split() == ["One,", ".", "Four"]


def test_decontaminate_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(odd_docs, none).count() == odd_docs.count()
    assert decontaminate.decontaminated(no_docs, none).collect() == []
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs into the wide")], "item_id long, text string")
    got = decontaminate.decontaminated(odd_docs, items)
    assert got.columns == odd_docs.columns and {r.doc_id for r in got.collect()}.isdisjoint({1, 2, 7})


def test_spans_below_the_limit_are_cut(spark):
    item = [f"i{k}" for k in range(20)]
    filler = [f"w{k}" for k in range(400)]
    texts = {
        1: filler[:200] + item[2:16] + filler[200:],  # 14 of 414 words
        2: filler[:100] + item[:14] + filler[100:200],  # 14 of 214 words: contaminated
        3: filler + item[:12],  # no whole window
        4: filler[:200] + item[:6] + item[:13] + item[6:13] + filler[200:],  # what is left around the cut is a window
        5: filler,
    }
    docs = spark.createDataFrame([(i, " ".join(ws).upper(), 7) for i, ws in texts.items()], "doc_id long, text string, n_chars int")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminated(docs, items).collect()}
    left = {i: [w.decode() for w in decontaminate.words(r.text)] for i, r in got.items()}
    assert left == {1: filler, 3: texts[3], 4: filler, 5: filler}
    assert got[1].n_chars == len(got[1].text) and got[5].n_chars == 7 and got[3].text == " ".join(texts[3]).upper()


def test_many_groups_read_texts_once(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: " ".join(f"v{rng.randint(0, 60)}" for _ in range(n))
    items = [(i, make(rng.choice([5, 13, 30, 200]))) for i in range(300)]
    docs = [(i, " ".join([make(20), " ".join(rng.choice(items)[1].split()[:40]), make(rng.randint(0, 400))])) for i in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.find_spans(d, b).collect()))
    written = []
    monkeypatch.setattr(decontaminate, "cut", lambda df, name: written.append(df.columns) or cut(df, name))
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 40)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 5000)
    assert len(decontaminate.automata_of(b, most=250)) > 200
    assert sorted(map(str, decontaminate.find_spans(d, b, group_bytes=250).collect())) == whole
    assert set(map(tuple, written)) == {("automaton",)}
    assert sorted(map(str, decontaminate.decontaminated(d, b, group_bytes=250).collect())) == sorted(map(str, decontaminate.decontaminated(d, b).collect()))


def test_repetitive_items_take_constant_work_a_word():
    text = b" ".join([b"a"] * 20_000).split()
    took = []
    for n in (500, 4000):
        a = decontaminate.Automaton([("x", "a " * n), ("y", "a a")])
        assert max(map(a.window_of.count, {a.window_of[-1]})) > n // 2
        began = time.process_time()
        assert a.match(text) == ([(0, 20_000)], {"x", "y"})
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 0.1


def test_digest_of_nothing(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
