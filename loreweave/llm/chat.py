"""Chat formatting with built-in functions only.

A table's nested field paths are hashed, for each layout those that it names; equal hashes select a declarative mapping
that turns prompt, instruction and message layouts into canonical turns (conv_id, turn, role, text). Turns are rendered as
ChatML-like text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
#: Reversible escapes, in the order of escaping; undone in the opposite order.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a schema; [] stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """paths: the leaf paths that make the layout. each: (array, role field, text field); turns: (role, text columns)."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] = ()
    by_row: bool = False


#: Whole conversations come before single exchanges: of layouts with equally many paths the first is taken.
LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), by_row=True),
    Layout("messages", ("conv_id", "messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("shared conversations", ("conv_id", "conversations[].from", "conversations[].value"), each=("conversations", "from", "value")),
    Layout("prompt", ("conv_id", "prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("conv_id", "instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("conv_id", "instruction", "input", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
)
#: The most specific layout first.
BY_FINGERPRINT = {fingerprint(x.paths): x for x in sorted(LAYOUTS, key=lambda x: -len(x.paths))}
#: Other names of the canonical roles.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_of(df: DataFrame) -> Layout:
    """The mapping with most paths of those whose paths all are in df, ties by their order in LAYOUTS; other paths are extra."""
    paths = set(field_paths(df.schema))
    for known, layout in BY_FINGERPRINT.items():
        if fingerprint(paths.intersection(layout.paths)) == known:
            return layout
    raise ValueError(f"no layout has the field paths {sorted(paths)}")


def canonical_turns(*tables: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) of tables of any known layouts; null roles and texts become empty."""
    return reduce(DataFrame.unionByName, [_turns(x) for x in tables])


def _turns(df: DataFrame) -> DataFrame:
    layout = layout_of(df)
    tops = list(dict.fromkeys(p.split("[")[0].split(".")[0] for p in layout.paths))
    exact = [i for top in tops for i, c in enumerate(df.columns) if c == top][: len(tops)]
    df = df.toDF(*[f"_c{i}" for i in range(len(df.columns))]).select(*[F.col(f"_c{i}").alias(t) for i, t in zip(exact, tops, strict=True)])
    if layout.by_row:
        rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    else:
        if layout.each:
            array, role, text = layout.each
            turns = F.transform(array, lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))
        else:
            turns = F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.nullif(F.col(c), F.lit("")) for c in texts]).alias("text")) for role, texts in layout.turns])
        rows = df.select("conv_id", F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")
        role = F.col("role")
        for other, usual in ROLE_ALIASES.items():
            role = F.when(F.col("role") == other, usual).otherwise(role)
        rows = rows.withColumn("role", role)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _replace(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, pairs=ESCAPES) -> Column:
    return _replace(c, pairs)


def unescape(c: Column, pairs=ESCAPES) -> Column:
    return _replace(c, [(b, a) for a, b in reversed(pairs)])


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: formatted text and its segments (text, loss), whose texts joined are the formatted text.

    Turns go by (turn, role, text), so ties and repeated rows have a defined place. Only assistant texts are under the
    loss. A conversation is one text and so one row; its size is the size of that text. No turns: no rows.
    """
    t = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def parts(x: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(START), escape(x["role"], ROLE_ESCAPES), F.lit(NEWLINE)), F.lit(False)),
            seg(escape(x["text"]), x["role"] == "assistant"),
            seg(F.lit(END + NEWLINE), F.lit(False)),
        )

    t = t.select("conv_id", F.flatten(F.transform("ts", parts)).alias("segments"))
    return t.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    turns = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda x: x != "")
    return F.transform(
        turns,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(START) + 1)), NEWLINE, 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(x, F.instr(x, NEWLINE) + 1)).alias("text"),
        ),
    )


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
