import pytest
from pyspark.sql import functions as F

from loreweave.operators import compress, consolidate
from loreweave.plans.schedule import Cycle, Latencies, retried


def test_a_skim_map_has_overview_facts_procedures_and_sections(spark):
    o = spark.createDataFrame(
        [(1, "s", "p", "Read", "notes.txt", "Alice moved to Berlin in spring", 1), (2, "s", "p", "Bash", "make deploy", "done", 2)],
        "observation_id long, session_id string, project string, tool string, input string, output string, created_at long",
    )
    m = spark.createDataFrame(
        [
            (7, "p", "s", "A move.", "session", 5, None, [" Alice moved to Berlin ", "Unheard zebra giraffe"], ["run make deploy"]),
            (8, "p", None, "Alone.", None, 5, None, None, None),
        ],
        "memory_id long, project string, session_id string, summary string, kind string, importance int, event_time string, facts array<string>, procedures array<string>",
    )
    rows = {r.chunk_id: r for r in compress.memory_chunks(m, o).collect()}
    mine = sorted((r for r in rows.values() if r.memory_id == 7), key=lambda r: r.ordinal)
    assert [r.chunk_id for r in mine] == [f"mem:7:{x}" for x in ("overview", "fact:1", "fact:2", "procedure:1", "obs:1", "obs:2")]
    assert [r.ordinal for r in mine] == [0, 1, 2, 3, 4, 5] and [r.kind for r in mine] == ["session", "fact", "fact", "procedural", "session", "session"]
    assert rows["mem:7:overview"].density == "high" and rows["mem:7:overview"].title == "Memory overview" and rows["mem:7:overview"].source_hash is None
    first = rows["mem:7:obs:1"]
    assert (rows["mem:7:fact:1"].start_byte, rows["mem:7:fact:1"].end_byte, rows["mem:7:fact:1"].source_hash) == (first.start_byte, first.end_byte, first.source_hash)
    assert rows["mem:7:fact:1"].summary == "Alice moved to Berlin" and rows["mem:7:fact:2"].start_byte is None and rows["mem:7:fact:2"].source_hash is None
    assert [r.chunk_id for r in rows.values() if r.memory_id == 8] == ["mem:8:overview"] and rows["mem:8:overview"].kind == "session"
    assert compress.memory_chunks(m.limit(0), o).count() == 0


def test_coverage_only_adds_and_derived_facts_are_new(spark):
    r = spark.range(1).select(
        compress.merged_facts(F.array(F.lit("A b"), F.lit("C")), F.array(F.lit(" a B "), F.lit("D"), F.lit("d"))).alias("x"),
        compress.merged_facts(F.lit(None).cast("array<string>"), F.array(F.lit("E"))).alias("y"),
        consolidate.derived_facts(F.lit("Derived facts:\n- none\n1. Alice lives in Berlin\n* Known already\n2) Bob drinks green tea\nshort"), F.array(F.lit("known ALREADY"))).alias("z"),
    ).first()
    assert r.x == ["A b", "C", "D"] and r.y == ["E"]
    assert r.z == ["Alice lives in Berlin", "Bob drinks green tea"]


def test_passing_errors_are_tried_again_with_doubled_waits():
    waits, left = [], [RuntimeError("HTTP 503"), RuntimeError("Rate limit"), None]

    def call():
        if error := left.pop(0):
            raise error
        return "ok"

    assert retried(call, sleep=waits.append) == "ok" and waits == [0.5, 1.0]
    left[:] = [RuntimeError("bad key")]
    with pytest.raises(RuntimeError, match="bad key"):
        retried(call, sleep=waits.append)
    left[:] = [RuntimeError("timeout")] * 3
    with pytest.raises(RuntimeError, match="timeout"):
        retried(call, sleep=waits.append)
    assert waits == [0.5, 1.0, 0.5, 1.0] and not left


def test_latencies_and_the_cycle():
    at = iter([0, 1500, 2000, 2500])
    seen = Latencies(clock=lambda: next(at))
    for _ in range(2):
        with seen.timed("search"):
            pass
    assert seen.stats() == {"search": {"count": 2, "avg_us": 1.0, "max_us": 1.5}}

    now, failed, dreams, waits = [0.0], iter([0, 2, 0]), [], []

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    def sweep():
        return next(failed)

    cycle = Cycle(sweep, lambda: dreams.append(now[0]), clock=lambda: now[0], sweep_every=10, dream_every=25, backoff=20)
    cycle.run(4, sleep)
    assert waits == [10, 20, 10, 20] and dreams == [0.0, 30.0] and len(cycle.errors) == 1  # the fourth sweep raises
