"""Names in questions, and the other ways in which they are written."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.text import QUESTION_WORDS

# Titles before a name, and how many names a question has at most.
TITLES = ("mr", "mrs", "ms", "dr")
MOST_NAMES = 8


def _is_name(word: str) -> bool:
    return len(word) >= 2 and word[0].isupper() and (len(word) >= 3 or word.isupper()) and word.lower() not in QUESTION_WORDS


def _short(word: str) -> bool:
    return len(word) >= 3 or (len(word) == 2 and word.isupper())


def aliases(name: str) -> list[str]:
    """The name, without its title, its first and last word, and its initials."""
    words = [w for w in re.split(r"[\W_]+", name) if w]
    while words and words[0].lower() in TITLES:
        words = words[1:]
    if len(words) < 2:
        return [name]
    initials = "".join(w[0].upper() for w in words)
    return [name, " ".join(words), *filter(_short, (words[0], words[-1])), *([initials] if len(initials) <= 8 else [])]


def graph_names(question: str | None) -> list[str]:
    """Capitalised phrases of a question, their words, and their aliases, lower-case, in order, eight at most."""
    found: list[str] = []
    for named, words in groupby(re.split(r"[\W_]", question or ""), key=_is_name):
        if named:
            words = list(words)
            found += [" ".join(words), *words] if len(words) > 1 else words
    return list(dict.fromkeys(a.lower() for name in found for a in aliases(name)))[:MOST_NAMES]


@F.pandas_udf(T.ArrayType(T.StringType()))
def names_of(questions: pd.Series) -> pd.Series:
    return questions.map(graph_names)
