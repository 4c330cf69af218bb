"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_place

#: White space that separates words.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"
WINDOW = 5

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the of and to in a is that it for with was on be are by this as at an or from "
    "de la le les et des en un une du que qui est pour dans par sur au avec "
    "el los las y del se por con una para su al lo "
    "der die und das von zu den mit sich auf für ist im dem nicht ein eine als auch es"
).split()

#: (rule, metric, comparison, bound): a text is kept if every row holds.
THRESHOLDS: tuple[tuple[str, str, str, float], ...] = (
    ("enough_words", "n_words", ">=", 10),
    ("word_length_low", "mean_word_chars", ">=", 2.0),
    ("word_length_high", "mean_word_chars", "<=", 20.0),
    ("few_symbols", "symbol_ratio", "<=", 0.1),
    ("few_marks", "mark_ratio", "<=", 0.3),
    ("some_stop_words", "stop_word_ratio", ">=", 0.02),
    ("few_repeated_lines", "dup_line_ratio", "<=", 0.5),
)


def _longs(c: Column) -> Column:
    return c.cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_dup_lines", "n_lines", "n_stop_words", "n_repeat_words")
JUDGED = ("base_failed", "failed_rules", "kept")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_marks, n_dup_lines, n_lines, n_stop_words and n_repeat_words.

    Null and empty texts have 0 everywhere. Texts of any length are measured whole; repeated rows are measured alike. A column
    of df with just the name of a measure is replaced, any other one stays as it is, also if the names differ in case alone.
    """
    return _named(df, _measured(by_place(df, text), text), MEASURES)


def _named(df: DataFrame, out: DataFrame, new: tuple[str, ...]) -> DataFrame:
    """The columns of df under their names, without those that are called like a new one, and the new ones."""
    kept = [(inner, name) for inner, name in zip(out.columns, df.columns, strict=False) if name not in new]
    return out.select(*[inner for inner, _ in kept], *new).toDF(*[name for _, name in kept], *new)


def _measured(df: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns(
        {
            "_words": F.filter(F.split(F.translate(body, SPACE, " " * len(SPACE)), " ", -1), lambda x: x != ""),
            "_lines": lines,
            "word_chars": _longs(F.char_length(F.translate(body, SPACE, ""))),
            "n_symbols": _longs(F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, ""))),
            "n_marks": _longs(F.char_length(body) - F.char_length(F.translate(body, MARKS, ""))),
        }
    )
    n = F.size("_words")
    df = df.withColumns(
        {
            "n_words": _longs(n),
            "n_lines": _longs(F.size("_lines")),
            "n_dup_lines": _longs(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_stop_words": _longs(F.size(F.filter("_words", lambda x: x.isin(*STOP_WORDS)))),
            "_windows": F.when(
                n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.concat_ws(" ", F.slice("_words", i, WINDOW)))
            ).otherwise(F.array().cast("array<string>")),
        }
    )
    df = df.withColumn("_repeated", F.size("_windows") > F.size(F.array_distinct("_windows")))
    df = df.withColumn("_sorted", F.when(F.col("_repeated"), F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))))
    pairs = F.zip_with(
        "_sorted",
        F.slice("_sorted", F.lit(2), F.greatest(F.size("_sorted"), F.lit(0))),
        lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    df = df.withColumn("_hit", F.when(F.col("_repeated"), F.array_sort(F.array_distinct(F.flatten(pairs)))))
    covered = F.aggregate(
        F.zip_with("_hit", F.slice("_hit", F.lit(2), F.greatest(F.size("_hit"), F.lit(0))), lambda a, b: F.when(b.isNull(), WINDOW).otherwise(F.least(F.lit(WINDOW), b - a))),
        F.lit(0),
        lambda s, x: s + x,
    )
    return df.withColumn("n_repeat_words", _longs(F.when(F.col("_repeated"), covered).otherwise(0)))


def compile_rules(thresholds=THRESHOLDS) -> tuple[Column, Column]:
    """One boolean for all rows of the table, and the array of the rules that fail."""
    def over(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    metrics = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "word_chars"),
        "mark_ratio": over("n_marks", "n_words"),
        "stop_word_ratio": F.coalesce(F.try_divide(F.col("n_stop_words") + 1.0, F.col("n_words").cast("double")), F.lit(0.0)),  # one is added: short texts may lack any
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
    }
    tests = {">=": lambda a, b: a >= F.lit(b), "<=": lambda a, b: a <= F.lit(b)}
    holds = {rule: tests[how](metrics[metric], float(bound)) for rule, metric, how, bound in thresholds}
    every = F.lit(True)
    for c in holds.values():
        every = every & c
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(rule)) for rule, c in holds.items()]))
    return every, failed


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def apply_rules(df: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """df with its measures, base_failed, failed_rules and kept; clashing names as in measure. An empty table gives an empty one."""
    every, failed = compile_rules(thresholds)
    out = _measured(by_place(df, text), text).withColumns({"base_failed": base_failed(), "failed_rules": failed, "kept": ~base_failed() & every})
    return _named(df, out, (*MEASURES, *JUDGED))
