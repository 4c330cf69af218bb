"""Symbols among traps, anchors that move, dictionaries of several ages, and evaluation that goes on."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import anchors, blobs
from loreweave.plans import evaluate, rerank
from loreweave.plans.engine import Engine

TRAPS = [
    '"}"', '"{ \\" {"', "'}'", "'\\''", "'{'", 'r"}"', 'r#"} " {"#', 'b"}"', "// }\n", "/* } /* { */ } */", "/// fn no() {\n", "'\\u{7d}'", '"// {"', "x as &'static str", "fn_like()", "r##\"\"# }\"##",
]


def test_braces_in_literals_end_nothing(spark):
    """Made files: every item's body holds some of the traps; where each item ends is known from how it was made."""
    rng, files, want = random.Random(3), [], set()
    for n in range(40):
        text = ""
        for i in range(rng.randint(1, 6)):
            kind, head = rng.choice([("function", "pub fn f{}<'a>(x: &'a str) "), ("struct", "struct S{} "), ("impl", "impl I{} "), ("module", "pub(crate) mod m{} ")])
            text += rng.choice(["", "\n", "  // fn hidden() {\n", '\nconst A: &str = "struct Hidden { ";\n', "/* mod gone { */\n"])
            text += "" if text.endswith("\n") or not text else "\n"
            body = "{ " + " ".join(rng.choice([*TRAPS, "{ y }", "let z = 1;"]) for _ in range(rng.randint(0, 8))) + "\n}"
            item = head.format(i) + body
            want.add((f"{n}.rs", kind, f"{kind[0]}{i}".replace("s", "S").replace("i", "I"), len(text.encode()), len((text + item).encode())))
            text += item
        files.append((f"{n}.rs", text + rng.choice(["", "\n// é {", "\n/* never closed {"])))
    found = anchors.symbols(spark.createDataFrame(files, "path string, text string")).collect()
    assert {(r.path, r.kind, r.name, r.start_byte, r.end_byte) for r in found} == want
    for _, text in files:
        plain = anchors.masked(text)
        assert len(plain) == len(text) and plain.count("\n") == text.count("\n")


BODY = "fn {name}(a: i32) -> i32 {{\n  let mut total = a;\n  for i in 0..10 {{ total += i * {k}; }}\n  println!(\"{{}}\", total);\n  total\n}}\n"


def test_anchors_follow_their_symbols(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    file = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    a, b = e.remember("p", "tally adds up and keep stays"), e.remember("p", "only other things")
    old = file(("a.rs", BODY.format(name="tally", k=3) + "struct keep { x: i32 }\nfn gone() { never_seen_again(1, 2, 3, 4) }\n"))
    assert e.anchor("p", old) == 2 and e.anchor("p", old) == 2
    assert {(r.memory_id, r.name, r.path) for r in e.anchored("p").collect()} == {(a, "tally", "a.rs"), (a, "keep", "a.rs")} and b
    new = file(("b.rs", "// moved\n" + BODY.format(name="sum_up", k=4)), ("a.rs", "\n\nstruct keep   { x: i32 }\n"))
    how = {r.name: (r.how, r.path, r.now_name) for r in e.relink("p", new).collect()}
    assert how == {"tally": ("moved", "b.rs", "sum_up"), "keep": ("kept", "a.rs", "keep")}
    assert {(r.name, r.path, r.start_byte) for r in e.anchored("p").collect()} == {("sum_up", "b.rs", 9), ("keep", "a.rs", 2)}
    assert [r.how for r in e.relink("p", file(("b.rs", BODY.format(name="sum_up", k=9)))).collect()] == ["changed"]
    assert e.relink("p", file(("c.rs", "fn unlike() {}"))).count() == 0 and e.anchored("p").count() == 2


def test_blobs_of_old_dictionaries_load(spark):
    record = lambda kind, i: f'{{"kind": "{kind}", "id": {i}, "message": "the usual message of a {kind} event", "level": "INFO"}}'
    kinds = "content_type string, data string, order long"
    first = spark.createDataFrame([("json", record("alpha", i), i) for i in range(80)], kinds)
    second = spark.createDataFrame([("json", record("beta", i), i) for i in range(80)], kinds)
    known = spark.createDataFrame([], "content_type string, hash string, data binary, trained_at long")
    known = blobs.registered(known, blobs.train_dictionaries(first), 1)
    assert blobs.registered(known, blobs.train_dictionaries(first), 5).collect() == known.collect()  # once
    rows = lambda kind: blobs.store(spark.createDataFrame([(record(kind, i),) for i in range(100, 140)] + [("",), ("q",)], "text string")).withColumn("content_type", F.lit("json"))
    none = known.limit(0)
    total = lambda p: p.agg(F.sum(F.octet_length("packed"))).first()[0]
    old = blobs.pack(rows("alpha"), known).cache()
    assert old.where("dictionary IS NOT NULL").count() >= 40 and total(old) < 0.7 * total(blobs.pack(rows("alpha"), none))
    known = blobs.registered(known, blobs.train_dictionaries(second), 2).cache()
    new = blobs.pack(rows("beta"), known)
    assert known.count() == 2 and new.where("dictionary IS NOT NULL").select("dictionary").distinct().first()[0] == known.where("trained_at = 2").first().hash
    for packed, kind in ((old, "alpha"), (new, "beta"), (blobs.pack(rows("beta"), none), "beta")):
        back = blobs.unpack(packed, known)
        assert back.where("NOT intact").count() == 0 and {r.text for r in back.collect()} == {record(kind, i) for i in range(100, 140)} | {"", "q"}


def test_only_close_questions_go_to_the_dear_scorer(spark):
    rng = random.Random(5)
    cheap = {(q, m): float(rng.randint(0, 9)) for q in range(30) for m in range(rng.randint(1, 5))}
    dear = {k: rng.random() for k in cheap}
    table = lambda d: spark.createDataFrame([(q, m, s) for (q, m), s in d.items()], "query_id long, memory_id long, score double")
    for budget in (None, 0, 7):
        asked = []

        def score(rows, asked=asked):
            asked.append({r.query_id for r in rows.collect()})
            return rows.drop("score").join(table(dear), ["query_id", "memory_id"])

        got = rerank.cascade(table(cheap), 1.5, score, budget).collect()
        gaps = {}
        for q, rows in itertools.groupby(sorted(cheap), key=lambda k: k[0]):
            best = sorted((cheap[k] for k in rows), reverse=True)
            if len(best) > 1 and best[0] - best[1] < 1.5:
                gaps[q] = best[0] - best[1]
        close = set(sorted(gaps, key=lambda q: (gaps[q], q))[: len(gaps) if budget is None else budget])
        assert asked[0] == close and {r.query_id for r in got if r.escalated} == close
        for q in range(30):
            by = dear if q in close else cheap
            assert [r.memory_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank0)] == [m for _, m in sorted((k for k in cheap if k[0] == q), key=lambda k: (-by[k], k[1]))]


def test_evaluation_goes_on_where_it_stopped(spark, tmp_path):
    q = spark.createDataFrame([(f"q{i}", f"what is {i}", ["reasoning", "temporal"][i % 2]) for i in range(40)], "question_id string, question string, ability string")
    asked = []

    def answer(rows, dies_after=None):
        asked.extend(r.question_id for r in rows.collect())
        if dies_after is not None and len(set(asked)) > dies_after:
            raise OSError("stopped")
        return rows.select("question_id", "ability", F.col("question").alias("answer"), (F.col("question_id") != "q3").alias("verdict"))

    with pytest.raises(OSError):
        evaluate.run(spark, q, lambda rows: answer(rows, 15), {"model": "a"}, str(tmp_path), 5)
    half = evaluate.results(spark, str(tmp_path)).count()
    assert 0 < half < 40
    first, asked[:] = set(asked), []
    done = evaluate.run(spark, q.orderBy(F.desc("question_id")), answer, {"model": "a"}, str(tmp_path), 5)
    assert done.count() == done.select("question_id").distinct().count() == 40 and len(asked) == 40 - half and first
    assert {(r.ability, r.n, r.n_correct) for r in evaluate.report(done).collect()} == {("reasoning", 20, 20), ("temporal", 20, 19)}
    asked.clear()
    assert evaluate.run(spark, q, answer, {"model": "a"}, str(tmp_path), 5).count() == 40 and not asked
    for other, settings, parts in ((q, {"model": "b"}, 5), (q.limit(39), {"model": "a"}, 5), (q.withColumn("question", F.concat("question", F.lit("?"))), {"model": "a"}, 5), (q, {"model": "a"}, 6)):
        with pytest.raises(evaluate.ManifestError):
            evaluate.run(spark, other, answer, settings, str(tmp_path), parts)
