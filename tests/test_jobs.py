"""The jobs over growing input, interrupted and run again, against plain versions."""

import datetime
import json
import os
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import close_sessions, index_texts, queries
from jobs.common import config_of, stream_path
from loreweave.functions.stem import stem, tokens
from loreweave.operators import fulltext

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def add_file(rows, folder, name):
    """One more file in a folder, as another writer would leave it."""
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.fixture
def folders(tmp_path):
    return [f"{tmp_path}/{x}" for x in ("in", "out", "mark")]


def index_of(texts):
    out = set()
    for i, text in texts.items():
        words = tokens(text)
        out |= {(i, len(words), x, n) for x, n in Counter(map(stem, words)).items()}
    return out


def indexed(spark, out):
    return {tuple(r) for r in fulltext.postings(spark, out).collect()}


DOCS = "doc_id long, text string, lang string"


def test_an_index_grows_with_its_input(spark, folders, monkeypatch):
    source, out, mark = folders
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    want = {r.doc_id: r.text for r in docs.collect()}
    add_file(docs.where("doc_id % 2 = 0"), source, "day=1")
    assert index_texts.run(spark, source, out, mark) == {"batches": 1, "rows": 100, "texts": 100}
    assert indexed(spark, out) == index_of({k: v for k, v in want.items() if k % 2 == 0})
    assert index_texts.run(spark, source, out, mark) == {"batches": 0, "rows": 0, "texts": 0}

    new = [(2, "altered words entirely", "en"), (4, None, "en"), (None, "no id", "en"), (9001, "twice a", "en"), (9001, "twice b", None), (9002, "", "en"), (9003, "same", "en"), (9003, "same", "en")]
    add_file(docs.where("doc_id % 2 = 1").union(spark.createDataFrame(new, DOCS)), source, "day=2")
    want |= {2: "altered words entirely", 4: None, 9001: "twice b", 9002: "", 9003: "same"}
    real = fulltext._save

    def dies(lengths, postings, path, segment):
        real(lengths.where("false"), postings.where("memory_id % 3 = 0"), path, segment)
        raise RuntimeError("the machine is gone")

    monkeypatch.setattr(fulltext, "_save", dies)
    with pytest.raises(Exception, match="the machine is gone"):
        index_texts.run(spark, source, out, mark)
    monkeypatch.setattr(fulltext, "_save", real)
    assert index_texts.run(spark, source, out, mark)["rows"] == 108
    assert indexed(spark, out) == index_of(want)
    assert {r.memory_id: r.length for r in fulltext.lengths(spark, out).collect()} == {k: len(tokens(v)) for k, v in want.items()}
    files = sorted(spark.read.parquet(f"{out}/postings").inputFiles())
    assert index_texts.run(spark, source, out, mark)["batches"] == 0 and sorted(spark.read.parquet(f"{out}/postings").inputFiles()) == files


SECONDS = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string, props string"


def events_of(spark, rows):
    return spark.createDataFrame([(i, u, None if s is None else SECONDS + datetime.timedelta(seconds=s), kind, "{}") for i, u, s, kind in rows], EVENTS)


def closed(runs, gap=1800, late=600):
    """The sessions that each run may close, one event after another."""
    seen, open_, mark, out = set(), defaultdict(list), None, []
    for rows in runs:
        for i, u, s, kind in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
            if i in seen or (mark is not None and s <= mark):
                continue
            seen.add(i)
            open_[u].append((s, i, kind))
        mark = max([r[2] for r in rows if r[2] is not None] + [(mark or 0) + late]) - late
        for u, events in open_.items():
            events.sort()
            groups = []
            for e in events:
                if groups and e[0] - groups[-1][-1][0] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            out += [(u, g[0][0], g[-1][0], len(g), len({e[2] for e in g} - {None}), sum(e[2] == "error" for e in g)) for g in groups if g[-1][0] + gap <= mark]
            open_[u] = [e for g in groups if g[-1][0] + gap > mark for e in g]
    return sorted(out, key=str)


def test_sessions_close_once_over_growing_input(spark, folders):
    source, out, mark = folders
    minute, hour = 60, 3600
    first = [(1, 7, 0, "view"), (2, 7, 20 * minute, "error"), (3, 7, 50 * minute, None), (4, 8, 10, "view"), (5, None, 5, "view"), (6, 9, None, "view"), (7, 9, 3 * hour, "click"), (7, 9, 3 * hour, "click")]
    second = [(8, 9, 3 * hour + 25 * minute, "error"), (7, 9, 3 * hour, "click"), (9, 7, 30, "too late"), (10, 8, 9 * hour, "view"), (11, 7, 3 * hour - 5 * minute, "view")]
    third = [(12, 10, 30 * hour, "view"), (13, 8, 9 * hour + 30 * minute, "view"), (14, 8, 10 * hour + 1 * minute, "view")]
    third[1:] = [(13, 8, 30 * hour, "view")]
    done = []
    for n, rows in enumerate((first, second, third)):
        add_file(events_of(spark, rows), source, f"day={n}")
        done.append(rows)
        r = close_sessions.run(spark, source, out, mark)
        assert (r["rows"], r["late"]) == (len(rows), 1 if n == 1 else 0)
        got = close_sessions.read(spark, out).collect()
        at = lambda t: int((t - SECONDS).total_seconds())
        assert sorted(((x.user_id, at(x.started_at), at(x.last_activity), x.n_events, x.n_kinds, x.n_failures) for x in got), key=str) == closed(done)
        assert all(x.day == x.started_at.strftime("%Y-%m-%d") for x in got)
        assert close_sessions.run(spark, source, out, mark)["rows"] == 0
        assert close_sessions.read(spark, out).count() == len(got)
    assert (7, 0, 50 * minute, 3, 2, 1) in closed(done) and (9, 3 * hour, 3 * hour + 25 * minute, 2, 2, 1) in closed(done)


def test_a_failed_run_is_made_good_by_the_next(spark, folders):
    """A file that can't be read stops the run; once it is mended, the same batch is read again and nothing counts twice or is lost."""
    source, out, mark = folders
    rows = [(i, i % 5, i * 700, "view") for i in range(60)]
    add_file(events_of(spark, rows[:30]), source, "a")
    close_sessions.run(spark, source, out, mark)
    before = sorted(map(str, close_sessions.read(spark, out).collect()))
    add_file(events_of(spark, rows[30:]), source, "b")
    name = next(f for f in os.listdir(f"{source}/b") if f.endswith(".parquet") and not f.startswith("."))
    good = open(f"{source}/b/{name}", "rb").read()
    crc = f"{source}/b/.{name}.crc"
    os.remove(crc)
    with open(f"{source}/b/{name}", "wb") as f:
        f.write(good[: len(good) // 2])
    with pytest.raises(Exception, match="(?i)parquet|stream"):
        close_sessions.run(spark, source, out, mark)
    assert sorted(map(str, close_sessions.read(spark, out).collect())) == before
    with open(f"{source}/b/{name}", "wb") as f:
        f.write(good)
    close_sessions.run(spark, source, out, mark)
    at = lambda t: int((t - SECONDS).total_seconds())
    got = close_sessions.read(spark, out).collect()
    assert sorted(((x.user_id, at(x.started_at), at(x.last_activity), x.n_events, x.n_kinds, x.n_failures) for x in got), key=str) == closed([rows[:30], rows[30:]])


def test_an_index_in_many_batches_is_one_index(spark, folders):
    source, out, mark = folders
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    for i in range(4):
        add_file(docs.where(F.col("doc_id") % 4 == i), source, f"part{i}")
    assert index_texts.run(spark, source, out, mark, {"files_per_batch": 1}) == {"batches": 4, "rows": 200, "texts": 200}
    assert {r.segment for r in fulltext.lengths(spark, out).select("segment").distinct().collect()} == {0, 1, 2, 3}
    want = index_of({r.doc_id: r.text for r in docs.collect()})
    assert indexed(spark, out) == want
    fulltext.remove(docs.where("doc_id < 10").select(F.col("doc_id").alias("memory_id")), out, fulltext.next_segment(spark, out))
    fulltext.compact(spark, out, f"{out}-2")
    assert indexed(spark, out) == indexed(spark, f"{out}-2") == {r for r in want if r[0] >= 10}
    assert {r.segment for r in fulltext.lengths(spark, f"{out}-2").select("segment").distinct().collect()} == {0}


def test_zones_change_nothing(spark, folders):
    source, out, mark = folders
    rows = [(1, 1, 0, "a"), (2, 1, 90 * 24 * 3600 + 7200, "a"), (3, 2, 300 * 24 * 3600, "a")]  # over both changes of the clocks
    add_file(events_of(spark, rows), source, "a")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        close_sessions.run(spark, f"{source}/*", out, mark)
        got = {(r.user_id, r.started_at) for r in close_sessions.read(spark, out).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {(1, SECONDS), (1, SECONDS + datetime.timedelta(seconds=rows[1][2]))}


def test_settings_and_paths():
    assert config_of(index_texts.__file__, {"stemming": False})["stemming"] is False
    with pytest.raises(ValueError, match="colour"):
        config_of(index_texts.__file__, {"colour": 1})
    assert stream_path("/a/b.parquet/") == "/a/b.parque[t]" and stream_path("/a/*.parquet") == "/a/*.parquet"


def test_command_line(tmp_path):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"stemming": False}))
    run = [sys.executable, "-m", "jobs.index_texts", "--input", "/root/testdata/sf0.001/documents.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", str(config)]
    for n in (200, 0):
        p = subprocess.run(run, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert p.returncode == 0, p.stderr[-2000:]
        assert json.loads(p.stdout.strip().splitlines()[-1])["rows"] == n and f"read {n} new rows" in p.stderr


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_like_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_a_question_reads_its_words_alone(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("memory_id"), "text")
    fulltext.add(docs, f"{tmp_path}/x", 0)
    word = fulltext.postings(spark, f"{tmp_path}/x").groupBy("token").count().where("count BETWEEN 5 AND 20").orderBy("token").first()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = fulltext.postings(spark, f"{tmp_path}/x", spark.createDataFrame([(word.token,)], "token string"))
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r.memory_id for r in rows} == {r.memory_id for r in docs.collect() if word.token in map(stem, tokens(r.text))} and len(rows) == word["count"]
    leaves = plan.collectLeaves()
    scan = next(x for x in (leaves.apply(i) for i in range(leaves.length())) if "bucket" in x.toString())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/x/postings").agg(F.sum("length"), F.count("*")).first()
    assert files[1] >= fulltext.BUCKETS and scan.metrics().apply("numFiles").value() == 1
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert 50 * scan.metrics().apply("filesSize").value() < texts and "token" in scan.toString().split("PushedFilters")[1].split("]")[0]
