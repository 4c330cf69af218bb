"""Code symbols, and the memories that mention them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Item keywords and what they are called.
KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module"}
ITEM = re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(fn|struct|enum|trait|impl|mod)\b(?:\s*<[^>{]*>)?\s+([A-Za-z_]\w*)")
SYMBOL = "path string, kind string, name string, start_byte long, end_byte long, hash string, shingles array<long>"
#: What can hold a brace that is none: comments, raw strings, strings, characters (not lifetimes, which no quote ends).
LITERAL = re.compile(r"""//[^\n]*|/\*|\bb?r(#*)"(?s:.*?)"\1|"(?s:\\.|[^"\\])*"|'(?:\\u\{[0-9a-fA-F_]*\}|\\x..|\\.|[^'\\\n])'""")
COMMENT = re.compile(r"/\*|\*/")
TOKENS = re.compile(r"\w+|[^\w\s]")
#: Tokens of a shingle, and the share of shingles that tells a moved and changed symbol.
SHINGLE, LIKE = 4, 0.5


def masked(text: str) -> str:
    """The text with blanks in place of comments, strings and characters; lines and places stay."""
    out, at = [], 0
    while m := LITERAL.search(text, at):
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth:
                mark = COMMENT.search(text, end)
                if not mark:
                    end = len(text)
                    break
                depth += 1 if mark[0] == "/*" else -1
                end = mark.end()
        out += [text[at : m.start()], re.sub(r"[^\n]", " ", text[m.start() : end])]
        at = end
    return "".join([*out, text[at:]])


def _shingles(body: str) -> list[int]:
    """Hashes of the runs of tokens of a symbol's body, without its name."""
    import zlib

    words = TOKENS.findall(body)
    runs = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()
    return sorted(zlib.crc32(x.encode()) for x in runs)


def _end(text: str, at: int) -> int:
    """After the matching brace, or the semicolon if that comes first."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
        elif text[i] == ";" and not depth:
            return i + 1
    return len(text)


def symbols(files: DataFrame) -> DataFrame:
    """Items of source files (path, text), found by keyword and braces outside of comments, strings and characters, with a hash
    that white space doesn't change, and the shingles of what stands between the braces."""
    import hashlib

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                text = text or ""
                plain = masked(text)
                for m in ITEM.finditer(plain):
                    end = _end(plain, m.end())
                    start = m.start() + len(m[0]) - len(m[0].lstrip(" \t"))
                    body = text[start:end]
                    rows.append((path, KINDS[m[1]], m[2], len(text[:start].encode()), len(text[:end].encode()), hashlib.sha256(" ".join(body.split()).encode()).hexdigest(), _shingles(plain[m.end() : end])))
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "start_byte", "end_byte", "hash", "shingles"])

    return files.select("path", "text").mapInPandas(find, SYMBOL)


def mentions(memories: DataFrame, found: DataFrame) -> DataFrame:
    """(memory_id, path, name, kind) of memories that name a symbol; words of the memory meet the names by equality."""
    words = memories.select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all("summary", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("name"))
    return words.join(found.select("path", "name", "kind").distinct(), "name")


def relink(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """Anchors (memory_id, name, kind, hash, and shingles if they have them) with the place where their symbol is now, and how it
    was found: kept (name and hash, of their own kind first), changed (name and kind), or moved (no such name: the symbol of
    their kind with the most shingles in common, at least the share LIKE of all of both).
    """
    key = ["memory_id", "name", "kind", "hash"]
    place = ["path", "start_byte", "end_byte", F.col("hash").alias("now_hash"), F.col("name").alias("now_name")]
    first = lambda rows, *order: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    own = anchors.select(*key, *[c for c in ("shingles",) if c in anchors.columns]).distinct()
    f = found.select("name", "kind", "hash", "path", "start_byte", "end_byte", *[c for c in ("shingles",) if c in found.columns])
    kept = own.select(*key).join(f.select("name", "hash", F.col("kind").alias("_kind"), "path", "start_byte", "end_byte"), ["name", "hash"])
    kept = first(kept, (F.col("_kind") != F.col("kind")).cast("int"), "path", "start_byte").select(*key, "path", "start_byte", "end_byte", F.col("hash").alias("now_hash"), F.col("name").alias("now_name"), F.lit("kept").alias("how"))
    rest = own.join(kept.select(*key), key, "left_anti")
    changed = rest.select(*key).join(f.select("name", "kind", "path", "start_byte", "end_byte", F.col("hash").alias("now_hash")), ["name", "kind"])
    changed = first(changed, "path", "start_byte").select(*key, "path", "start_byte", "end_byte", "now_hash", F.col("name").alias("now_name"), F.lit("changed").alias("how"))
    out = kept.unionByName(changed)
    if "shingles" not in own.columns or "shingles" not in f.columns:
        return out
    rest = rest.join(changed.select(*key), key, "left_anti").where("size(shingles) > 0")
    a = rest.select(*key, F.size("shingles").alias("_a"), F.explode("shingles").alias("_s"))
    b = f.select("kind", *place, F.size("shingles").alias("_b"), F.explode("shingles").alias("_s"))
    shared = a.join(b, ["kind", "_s"]).groupBy(*key, "path", "start_byte", "end_byte", "now_hash", "now_name", "_a", "_b").agg(F.count("*").alias("_c"))
    like = shared.withColumn("_like", F.col("_c") / (F.col("_a") + F.col("_b") - F.col("_c"))).where(F.col("_like") >= LIKE)
    return out.unionByName(first(like, F.desc("_like"), "path", "start_byte").drop("_a", "_b", "_c", "_like").withColumn("how", F.lit("moved")))
