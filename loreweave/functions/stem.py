"""The Porter stemmer (M. F. Porter, 1980) over ASCII tokens, from one table of rules: as a function and as SQL.

A token is a run of ASCII letters and digits and of any characters beyond ASCII; only A-Z are lower-cased. Characters beyond
ASCII count as consonants.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The published rules, and the bytes of the tokens that are stemmed at all.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Measure above 0, above 1, just 1; a vowel; one consonant cluster, a vowel and a consonant but w, x, y.
CONDITIONS = {
    "m>0": f"^({CONSONANTS})?{VOWELS}{CONSONANTS}",
    "m>1": f"^({CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}",
    "m=1": f"^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$",
    "*v*": f"^({CONSONANTS})?[aeiouy]",
    "*o": f"^{CONSONANTS}[aeiouy][^aeiouwxy]$",
    "*st": "[st]$",
}
DOUBLED = "bcdfghjkmnpqrtvwxy0123456789"
LEAST_BYTES, MOST_BYTES = 3, 64
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP_3 = (("ical", "ic"), ("ness", ""), ("icate", "ic"), ("iciti", "ic"), ("ful", ""), ("ative", ""), ("alize", "al"))
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

#: Steps of rules (suffix, replacement, conditions on what is before it), the longest suffix first; one rule of a step is tried.
Rule = tuple[str, str, tuple[str, ...]]


def _longest(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r[0]))


BEFORE: list[list[Rule]] = [_longest([("sses", "ss", ()), ("ies", "i", ()), ("ss", "ss", ()), ("s", "", ())])]
PAST: list[Rule] = [("eed", "ee", ("m>0",)), ("ing", "", ("*v*",)), ("ed", "", ("*v*",))]
AFTER: list[list[Rule]] = [
    [("y", "i", ("*v*",))],
    _longest([(a, b, ("m>0",)) for a, b in STEP_2]),
    _longest([(a, b, ("m>0",)) for a, b in STEP_3]),
    _longest([(a, "", ("m>1", "*st") if a == "ion" else ("m>1",)) for a in STEP_4]),
]

_HOLDS = {k: re.compile(p).search for k, p in CONDITIONS.items()}
#: The steps with the endings that they look for; and the last two characters, or the only one, of all: other words are their own stems.
_BEFORE, _AFTER = ([(rules, tuple(r[0] for r in rules)) for rules in steps] for steps in (BEFORE, AFTER))
_PAST = tuple(r[0] for r in PAST)
_LAST = frozenset({r[0][-2:] for rules in (*BEFORE, PAST, *AFTER) for r in rules} | {"e", "ll"})
_OTHER = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _apart(text: str | None) -> str:
    """The text in lower case, with a blank for each character that is in no token."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_OTHER).decode("utf-8", "surrogatepass")


def tokens(text: str | None) -> list[str]:
    """The tokens of an indexed text."""
    return [x for x in _apart(text).split(" ") if x]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The tokens of all texts in turn: the place of the text of each, its number, and the distinct ones, by number."""
    words = pc.split_pattern(pa.array([_apart(x) for x in texts.to_pylist()], pa.string()), " ")
    at = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    names, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    some = number != names.index("") if "" in names else slice(None)
    return at[some], number[some], names


def asked_tokens(query: str | None) -> list[str]:
    """The tokens of a query, which is split at all that is neither letter nor digit, also beyond ASCII; each once."""
    return list(dict.fromkeys(tokens(" ".join(re.findall(r"[^\W_]+", query or "")))))


def _step(word: str, rules: list[Rule]) -> str:
    for suffix, new, conditions in rules:
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            return rest + new if all(_HOLDS[c](rest) for c in conditions) else word
    return word


def stem(word: str) -> str:
    if word[-2:] not in _LAST and word[-1:] not in _LAST or not LEAST_BYTES <= len(word.encode("utf-8", "surrogatepass")) <= MOST_BYTES:
        return word
    for rules, ends in _BEFORE:
        if word.endswith(ends):
            word = _step(word, rules)
    short = _step(word, PAST) if word.endswith(_PAST) else word
    if short != word and not word.endswith("eed"):
        if short.endswith(("at", "bl", "iz")):
            short += "e"
        elif len(short) > 1 and short[-1] == short[-2] and short[-1] in DOUBLED:
            short = short[:-1]
        elif _HOLDS["m=1"](short) and _HOLDS["*o"](short):
            short += "e"
    word = short
    for rules, ends in _AFTER:
        if word.endswith(ends):
            word = _step(word, rules)
    if word.endswith("e"):
        rest = word[:-1]
        if _HOLDS["m>1"](rest) or (_HOLDS["m=1"](rest) and not _HOLDS["*o"](rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _HOLDS["m>1"](word[:-1]) else word


class Wanted:
    """Which words may have one of some stems: a stem without its last two characters, or its first, begins its words."""

    def __init__(self, stems, longest: int = 6):
        self.by: dict[int, set[str]] = {}
        for x in stems:
            n = min(longest, max(1, len(x) - 2))
            self.by.setdefault(n, set()).add(x[:n])
        self.starts = sorted(self.by.items())

    def may_have(self, word: str) -> bool:
        for n, some in self.starts:  # goes through most words at the first
            if word[:n] in some:
                return True
        return False


# SQL


def _when(condition: str, c: str) -> str:
    return f"regexp_matches({c}, '{CONDITIONS[condition]}')"


def _step_sql(c: str, rules: list[Rule]) -> str:
    cases = ""
    for suffix, new, conditions in rules:
        rest = f"left({c}, length({c}) - {len(suffix)})"
        short = f"{rest} || '{new}'" if new else rest
        cases += f" WHEN ends_with({c}, '{suffix}') THEN " + (f"CASE WHEN {' AND '.join(_when(x, rest) for x in conditions)} THEN {short} ELSE {c} END" if conditions else short)
    return f"CASE{cases} ELSE {c} END"


def stems_sql(name: str, words: str) -> str:
    """Common table expressions that end in name(token, stem), for the distinct tokens of the query `words`."""
    ctes = [f"{name}_0 AS (SELECT token, token AS w, strlen(token) BETWEEN {LEAST_BYTES} AND {MOST_BYTES} AS fit FROM ({words}) AS t)"]

    def then(expression: str) -> None:
        n = len(ctes)
        ctes.append(f"{name}_{n} AS (SELECT * REPLACE (CASE WHEN fit THEN {expression} ELSE w END AS w) FROM {name}_{n - 1})")

    for rules in BEFORE:
        then(_step_sql("w", rules))
    n = len(ctes)
    ctes.append(f"{name}_{n} AS (SELECT token, fit, w AS was, CASE WHEN fit THEN {_step_sql('w', PAST)} ELSE w END AS w FROM {name}_{n - 1})")
    doubled = f"length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) AND contains('{DOUBLED}', right(w, 1))"
    then(
        "CASE WHEN w = was OR ends_with(was, 'eed') THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e' "
        f"WHEN {doubled} THEN left(w, length(w) - 1) WHEN {_when('m=1', 'w')} AND {_when('*o', 'w')} THEN w || 'e' ELSE w END"
    )
    for rules in AFTER:
        then(_step_sql("w", rules))
    rest = "left(w, length(w) - 1)"
    then(f"CASE WHEN ends_with(w, 'e') AND ({_when('m>1', rest)} OR ({_when('m=1', rest)} AND NOT {_when('*o', rest)})) THEN {rest} ELSE w END")
    then(f"CASE WHEN ends_with(w, 'll') AND {_when('m>1', rest)} THEN {rest} ELSE w END")
    return ",\n".join([*ctes, f"{name} AS (SELECT token, w AS stem FROM {name}_{len(ctes) - 1})"])


def asked_sql(c: str) -> str:
    return tokens_sql(f"array_to_string(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}]+'), ' ')")


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
