import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loreweave.llm import fill_middle, queries

UNITS = {"char": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}


def units(text, unit):
    found = re.findall(UNITS[unit], text)
    lead = text[: len(text) - len("".join(found))] if unit == "word" else ""
    return [lead + found[0], *found[1:]] if found else [text] if text else []


def plain(doc_id, text, unit="char", seed="1"):
    """The transformation by lists of units."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    us = units(text, unit)
    a, b = sorted((h1 % (len(us) + 1), h2 % (len(us) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(us), "plain", None, None, text
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if h4 % 100 < 20:
        return doc_id, len(us), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(us), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\rab<PSM>é日😀\x00\x0b "), st.characters(codec="utf-8")), max_size=200), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts(text, r1, r2):
    for unit in UNITS:
        us = units(text, unit)
        a, b = sorted((r1 % (len(us) + 1), r2 % (len(us) + 1)))
        assert "".join(us) == text
        assert fill_middle.cut(text.encode(), unit, r1, r2) == (len(us), a, b, len("".join(us[:a]).encode()), len("".join(us[:b]).encode()))


@given(st.integers(0, 2**700), st.lists(st.integers(0, 720), max_size=5))
def test_select(bits, ranks):
    at = [i for i in range(701) if bits >> i & 1]
    ranks.sort()
    assert fill_middle.select(bits, 701, ranks) == [at[r] if r < len(at) else 701 for r in ranks]


def test_odd_texts(spark, odd_docs, clashing_docs, no_docs):
    ends = [(100 + i, t, None, None, None, None, None) for i, t in enumerate(("<", "<S", "ends with <", "<P>", "a<M>b", "<S<S", "P>x<", "日本語\n日本語", " \n ", "x" * 200_000 + "é" * 100_000))]
    docs = odd_docs.union(spark.createDataFrame(ends, odd_docs.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for unit in UNITS:
        got = fill_middle.transform(docs, unit=unit)
        want = sorted((plain(i, t, unit) for i, t in rows), key=str)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        back = got.select("doc_id", fill_middle.restore(F.col("output"), F.col("form")).alias("t")).collect()
        assert sorted((r.doc_id, r.t) for r in back if r.doc_id) == sorted((i, t or "") for i, t in rows if i)
    assert sorted(map(str, fill_middle.transform(clashing_docs).collect())) == sorted(map(str, fill_middle.transform(odd_docs).collect()))
    assert fill_middle.transform(no_docs).count() == 0


def test_every_form_restores(spark):
    docs = spark.createDataFrame([(i, f"<{'S' * (i % 3)} text {i} <P> "[: 12 + i % 9] + "<" * (i % 4)) for i in range(400)], "doc_id long, text string")
    got = fill_middle.transform(docs).join(docs, "doc_id").select("form", "text", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.text == r.back for r in got)


def test_query(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        i, n, form, a, m, out = plain(r.doc_id, r.text)
        want[i] = (n, form, a, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in queries.op12_fill_middle(spark, sf).collect()}
    assert got == want
