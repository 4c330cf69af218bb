"""Transcripts with byte ranges, skim chunks, corrections, and parsers of structured replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.dates import is_date_or_range
from loreweave.functions.text import any_of, chunk_summary, clip_words, source_terms, token_estimate, truncate_bytes, word_count

# What a failed command says, and which tools change code.
FAIL_MARKERS = (
    "error:", "error[", "fatal:", "panicked at", "traceback (most recent call last)", "command not found", "no such file or directory",
    "could not compile", "build failed", "test result: failed", "exit code 1", "exit status 1", "segmentation fault", "assertion failed", "cannot find",
)
CATEGORIES = ("decision", "fact", "preference", "error_fix", "event")
COMMAND_TOOL = "Bash"
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
MOST_CORRECTIONS = 5
HIGH_WORDS = ("error", "failed", "panic", "fix", "test result", "commit", "push")
HIGH_KINDS = ("fact", "procedural", "error_solution")
MEDIUM_KINDS = ("architecture", "learned_pattern", "project_config", "preference", "profile")


def section_text() -> Column:
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), F.col(c), F.lit("\n")), F.lit(""))
    return F.concat(F.lit("## "), F.col("tool"), F.lit("\n"), line("input", "input"), line("output", "output"), F.lit("\n"))


def transcript_sections(observations: DataFrame) -> DataFrame:
    """One row per observation with its text and its byte range in the session's transcript."""
    w = Window.partitionBy("session_id").orderBy("created_at", "observation_id")
    o = observations.withColumn("text", section_text())
    o = o.withColumns({"ordinal": F.row_number().over(w), "end_byte": F.sum(F.octet_length("text")).over(w)})
    return o.withColumn("start_byte", F.col("end_byte") - F.octet_length("text"))


def transcripts(observations: DataFrame) -> DataFrame:
    s = transcript_sections(observations).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("s"))
    return s.select("session_id", F.array_join(F.col("s.text"), "").alias("transcript"))


def memory_density(kind: Column, importance: Column, dated: Column, n_facts: Column) -> Column:
    """importance from 1 to 10."""
    return F.when(kind.isin(*HIGH_KINDS) | dated | (n_facts > 0) | (importance >= 8), "high").when(kind.isin(*MEDIUM_KINDS) | (importance >= 6), "medium").otherwise("low")


def section_density(text: Column, parent: Column) -> Column:
    return F.when(any_of(F.lower(text), HIGH_WORDS), "high").when((parent == "high") | (word_count(text) > 160), "medium").otherwise("low")


def chunk_title(prefix: Column, text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.trim(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), prefix), "^(## )+", ""))
    title = clip_words(first, 10)
    return F.when(title == "", prefix).otherwise(title)


def skim_chunks(observations: DataFrame, parent_density: str = "low", kind: str = "session") -> DataFrame:
    """A chunk of each section: density, title, clipped summary, byte range and estimated tokens."""
    s = transcript_sections(observations)
    density = section_density(F.col("text"), F.lit(parent_density))
    return s.select(
        F.concat(F.lit("mem:"), "session_id", F.lit(":obs:"), F.col("observation_id").cast("string")).alias("chunk_id"),
        "session_id", "project", "ordinal", density.alias("density"), F.lit(kind).alias("kind"),
        F.concat(chunk_title(F.col("tool"), F.col("text")), F.lit(" observation "), F.col("observation_id").cast("string")).alias("title"),
        chunk_summary(F.col("text"), density).alias("summary"), "start_byte", "end_byte", token_estimate(F.col("text")).alias("token_estimate"), "created_at",
    )


def overview_chunks(memories: DataFrame) -> DataFrame:
    """The overview alone of memories (memory_id, project, session_id, summary, kind, importance, event_time), as memory_chunks gives it."""
    density = memory_density(F.col("kind"), F.col("importance"), F.coalesce(F.trim("event_time") != "", F.lit(False)), F.lit(0))
    return memories.select(
        F.concat(F.lit("mem:"), F.col("memory_id").cast("string"), F.lit(":overview")).alias("chunk_id"),
        "project", "memory_id", "session_id", F.lit(0).alias("ordinal"), density.alias("density"), "kind", F.lit("Memory overview").alias("title"),
        chunk_summary(F.col("summary"), density).alias("summary"), token_estimate(F.col("summary")).alias("token_estimate"),
    )


def memory_chunks(memories: DataFrame, observations: DataFrame) -> DataFrame:
    """The skim map of each memory: its overview, facts, procedures and the sections of its session, in this order from 0.

    memories: memory_id, project, session_id, summary, kind, importance (1 to 10), event_time, facts, procedures. A fact or
    procedure points to the section of its session that tells it, if one does. A memory without a session has no sections.
    """
    listed = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("facts", "procedures")}
    m = memories.withColumns(listed | {"kind": F.coalesce("kind", F.lit("session"))})
    m = m.withColumn("density", memory_density(F.col("kind"), F.col("importance"), F.coalesce(F.trim("event_time") != "", F.lit(False)), F.size("facts")))
    said = lambda part, c: F.transform(c, lambda x, i: F.struct(F.lit(part).alias("part"), (i + 1).alias("n"), x.alias("text")))
    parts = F.concat(said("overview", F.array("summary")), said("fact", F.col("facts")), said("procedure", F.col("procedures")))
    own = m.select("memory_id", "project", "session_id", "kind", "density", F.posexplode(parts).alias("ordinal", "p")).select("*", "p.*").drop("p")
    first = F.col("part") == "overview"
    text = F.trim("text")
    own = own.select(
        F.concat(F.lit("mem:"), F.col("memory_id").cast("string"), F.lit(":"), "part", F.when(first, "").otherwise(F.concat(F.lit(":"), F.col("n").cast("string")))).alias("chunk_id"),
        "project", "memory_id", "session_id", "ordinal", F.when(first, F.col("density")).otherwise("high").alias("density"),
        F.when(first, F.col("kind")).when(F.col("part") == "fact", "fact").otherwise("procedural").alias("kind"),
        F.when(first, "Memory overview").when(F.col("part") == "fact", chunk_title(F.lit("Fact"), text)).otherwise(chunk_title(F.lit("Procedure"), text)).alias("title"),
        F.when(first, chunk_summary(F.col("text"), F.col("density"))).otherwise(text).alias("summary"), token_estimate(F.col("text")).alias("token_estimate"),
    )
    sections = transcript_sections(observations)
    digests = transcripts(observations).select("session_id", F.sha2("transcript", 256).alias("source_hash"))
    asked = own.where("NOT chunk_id LIKE '%:overview'").select(F.col("chunk_id").alias("fact_id"), F.col("summary").alias("fact"), "session_id")
    spans = best_span(F.col("fact"), asked.join(sections.select("session_id", "text", "start_byte", "end_byte"), "session_id")).withColumnRenamed("fact_id", "chunk_id")
    own = own.join(spans, "chunk_id", "left").join(digests, "session_id", "left").withColumn("source_hash", F.when(F.col("start_byte").isNotNull(), F.col("source_hash")))

    heads = m.select("memory_id", "session_id", "kind", F.col("density").alias("_parent"), (F.size("facts") + F.size("procedures")).alias("_before"))
    density = section_density(F.col("text"), F.col("_parent"))
    number = F.col("observation_id").cast("string")
    told = sections.join(heads, "session_id").join(digests, "session_id").select(
        F.concat(F.lit("mem:"), F.col("memory_id").cast("string"), F.lit(":obs:"), number).alias("chunk_id"),
        "project", "memory_id", "session_id", (F.col("_before") + F.col("ordinal")).alias("ordinal"), density.alias("density"), "kind",
        F.concat(chunk_title(F.col("tool"), F.col("text")), F.lit(" observation "), number).alias("title"),
        chunk_summary(F.col("text"), density).alias("summary"), token_estimate(F.col("text")).alias("token_estimate"), "start_byte", "end_byte", "source_hash",
    )
    return own.unionByName(told)


def merged_facts(facts: Column, more: Column) -> Column:
    """The facts, then those of `more` that are not there yet, without regard to ASCII case and outer blanks.

    Equal ones meet by sorting, so long lists take no pairwise comparison. Null lists count as empty.
    """
    none = F.array().cast("array<string>")
    key = lambda x: F.translate(F.regexp_replace(x, r"^\s+|\s+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    row = lambda n: lambda x, i: F.struct(key(x).alias("key"), F.lit(n).alias("list"), i.alias("i"), x.alias("x"))
    rows = F.array_sort(F.concat(F.transform(F.coalesce(facts, none), row(0)), F.transform(F.coalesce(more, none), row(1))))
    # Nothing that goes through a list may stand inside a lambda: it would be computed anew for each element. So the sorted rows are a variable.
    new = lambda rows: F.filter(rows, lambda r, i: (r["list"] == 0) | (i == 0) | ~r["key"].eqNullSafe(F.get(rows, i - 1)["key"]))
    kept = F.array_sort(F.transform(F.get(F.transform(F.array(rows), new), F.lit(0)), lambda r: F.struct(r["list"].alias("list"), r["i"].alias("i"), r["x"].alias("x"))))
    return F.transform(kept, lambda r: r["x"])


def local_compression(observations: DataFrame, most: int = 48_000) -> DataFrame:
    """The memory of each session without a language model: a header and its transcript, cut at `most` bytes."""
    n = observations.groupBy("session_id", "project").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("tool")).alias("tools"))
    t = transcripts(observations).join(n, "session_id")
    head = F.concat(F.lit("Session of "), F.col("n").cast("string"), F.lit(" observations in "), F.col("project"), F.lit("\n\n"))
    return t.select("session_id", "project", F.concat(head, truncate_bytes(F.col("transcript"), most)).alias("summary"), F.array_join("tools", " ").alias("tags"), F.lit(5).alias("importance"))


def best_span(fact: Column, sections: DataFrame) -> DataFrame:
    """The section (fact_id, start_byte, end_byte) that shares most terms with a fact, two at least; the fact itself if it is there.

    sections: fact_id, fact, text, start_byte, end_byte of the fact's own session.
    """
    exact = F.instr(F.lower("text"), F.lower(F.trim(fact)))
    shared = F.size(F.array_intersect(source_terms(fact), source_terms(F.col("text"))))
    s = sections.withColumns({"_exact": (F.octet_length(F.trim(fact)) >= 8) & (exact > 0), "_n": shared}).where("_exact OR _n >= 2")
    found = s.groupBy("fact_id").agg(F.max_by(F.struct("start_byte", "end_byte"), F.struct("_exact", "_n", -F.col("start_byte"))).alias("s"))
    return found.select("fact_id", "s.start_byte", "s.end_byte")


def _head(text) -> str | None:
    parts = (text or "").split()
    return parts[0] if parts else None


def _failed(output) -> bool:
    return any(any(m in line.lower() for m in FAIL_MARKERS) for line in (output or "").splitlines())


def _cut(text: str, most: int) -> str:
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode("utf-8", "ignore") + "… [truncated]"


def corrections_of(rows: list[tuple[str, str | None, str | None]]) -> list[tuple[str, str]]:
    """(problem, solution) of ordered (tool, input, output): a failed command and its next success with the edits between.

    The look-ahead stops at the first success of the command's first word; it counts if the command is the same or
    something was edited.
    """
    waiting: list[dict] = []
    solved: dict[int, tuple[str, str]] = {}
    for i, (tool, given, output) in enumerate(rows):
        text = (given or "").strip()
        if tool in EDIT_TOOLS:
            target = _cut(text, 80)
            for w in waiting:
                if target and target not in w["edited"]:
                    w["edited"].append(target)
        elif tool == COMMAND_TOOL and (head := _head(text)) is not None:
            if _failed(output):
                lines = (output or "").splitlines()
                line = next((x for x in lines if _failed(x)), "")
                waiting.append({"at": i, "head": head, "input": given, "edited": [], "problem": f"`{_cut(text, 200)}` failed: {_cut(line.strip(), 200)}"})
            else:
                for w in [w for w in waiting if w["head"] == head]:
                    if given == w["input"] or w["edited"]:
                        how = f"edited {', '.join(w['edited'])}; " if w["edited"] else ""
                        solved[w["at"]] = (w["problem"], f"{how}re-ran `{_cut(text, 120)}` → passed")
                    waiting.remove(w)
    return list(dict.fromkeys(solved[k] for k in sorted(solved)))[:MOST_CORRECTIONS]


def mine_corrections(observations: DataFrame) -> DataFrame:
    """(session_id, ordinal, problem, solution) of each session with a failed command."""
    bad = any_of(F.lower("output"), FAIL_MARKERS)
    some = observations.where((F.col("tool") == COMMAND_TOOL) & bad).select("session_id").distinct()
    rows = observations.join(some, "session_id", "left_semi").select("session_id", "observation_id", "created_at", "tool", "input", "output")

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["created_at", "observation_id"])
        pdf = pdf.astype(object).where(pdf.notna(), None)
        found = corrections_of(list(zip(pdf["tool"], pdf["input"], pdf["output"], strict=True)))
        session = pdf["session_id"].iloc[0]
        return pd.DataFrame([(session, i, p, s) for i, (p, s) in enumerate(found)], columns=["session_id", "ordinal", "problem", "solution"])

    return rows.groupBy("session_id").applyInPandas(mine, "session_id string, ordinal int, problem string, solution string")


def observer_lines(rows: DataFrame, text: str) -> DataFrame:
    """`- [date] Pn category: text` lines, with the importance of their priority. What is no date is none; other categories are events."""
    pattern = r"^- \[([^\]]*)\]\s*P([1-3]) ([^:]*):\s*(\S.*)$"
    rows = rows.select("*", F.explode(F.split(text, "\n")).alias("_line")).where(F.trim("_line").rlike(pattern))
    part = lambda i: F.trim(F.regexp_extract(F.trim("_line"), pattern, i))
    p = part(2)
    day, category = F.when(is_date_or_range(part(1)), part(1)), F.lower(part(3))
    return rows.select("*", day.alias("day"), p.cast("int").alias("priority"), F.when(category.isin(*CATEGORIES), category).otherwise("event").alias("category"), part(4).alias("line"), F.when(p == "1", 0.85).when(p == "2", 0.7).otherwise(0.55).alias("importance")).drop("_line", text)


FIELDS = ("SUMMARY", "FACTS", "TAGS", "IMPORTANCE", "KIND", "WHEN", "ENTITIES", "RELATIONS", "PROCEDURES")
LISTS = ("facts", "entities", "relations", "procedures")
REPLY = T.StructType([T.StructField(f.lower(), T.ArrayType(T.StringType()) if f.lower() in LISTS else T.IntegerType() if f == "IMPORTANCE" else T.StringType()) for f in FIELDS])


def prompt(transcript: str) -> str:
    """What a language model is asked about a session, so that parse_reply can read its answer."""
    lists = ", ".join(x.upper() for x in LISTS)
    return f"Condense this session. Answer in named fields, one per line: {', '.join(FIELDS)}. {lists} are lists with a leading dash; a relation is source | relation | target.\n\n{transcript}"


def parse_reply(text: str | None) -> dict:
    """A structured reply: named fields, whose lists are lines with a leading dash; lists lose repeats, importance is 1 to 10."""
    found: dict[str, list[str]] = {}
    field = None
    for line in (text or "").splitlines():
        name, colon, rest = line.partition(":")
        if colon and name.strip().upper() in FIELDS:
            field = name.strip().upper()
            line = rest
        if field and (item := line.strip().removeprefix("-").strip()):
            found.setdefault(field, []).append(item)
    lists = {k: list({x.lower(): x for x in reversed(found.get(k, []))}.values())[::-1] for k in ("FACTS", "ENTITIES", "RELATIONS", "PROCEDURES")}
    number = "".join(c for c in "".join(found.get("IMPORTANCE", [])) if c.isdigit())
    one = lambda k: " ".join(found.get(k, [])) or None
    return {"summary": one("SUMMARY"), "facts": lists["FACTS"], "tags": one("TAGS"), "importance": min(max(int(number), 1), 10) if number else 5, "kind": (one("KIND") or "session").lower(), "when": one("WHEN"), "entities": lists["ENTITIES"], "relations": lists["RELATIONS"], "procedures": lists["PROCEDURES"]}


@F.pandas_udf(REPLY)
def parse_replies(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([parse_reply(t) for t in batch])
