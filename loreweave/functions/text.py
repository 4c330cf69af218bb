"""Text rules as column expressions: tokens, stop words, normal forms, word counts and clips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, cues and bounds of the retrieval semantics.
TEMPORAL_STOPWORDS = (
    "when what which where who whom whose why how did does do was were is are has have had the this that with from into onto about "
    "date day time year month week weeks days months years long many before after prior following happen happened first last latest recent more most"
).split()
QUESTION_WORDS = "what when where which who whom whose why how did does do is are was were show tell list give".split()
TERM_STOPWORDS = "the and for with that this from into when then than should must will memory session".split()
SOURCE_STOPWORDS = "that this with from have into will should memory session".split()
TEMPORAL_CUES = (
    "what date", "which date", "what day", "which day", "what month", "which month", "what year", "which year", "what time", "how long",
    "how many days", "how many weeks", "how many months", "how many years", " before ", " after ", " prior to ", " following ",
)
MULTI_HOP_CUES = (
    " after ", " before ", " then ", " same ", " also ", " both ", " depend ", " depends ", " dependent ", " dependency ", " who else",
    " what else", " where did ", " how did ", " because ", " led to ", " compared ", " related to ", " connected ", " between ",
)
SUFFIXES = ("'s", "ing", "edly", "ed", "es", "s")
MEMORY_KINDS = ("session", "error_solution", "preference", "procedural", "architecture", "learned_pattern", "project_config", "profile", "fact", "inference", "observation")
CURRENT_STATE = ("is", "status", "state", "role", "location", "works_at", "lives_at", "assigned_to", "owner", "primary")

ALNUM = r"[\p{L}\p{N}]+"


def words_of(c: Column, pattern: str = ALNUM) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)


def normalize_event_token(t: Column) -> Column:
    """Lower case, without the first of the suffixes that leaves more than three characters."""
    t = F.lower(t)
    out = t
    for s in reversed(SUFFIXES):
        out = F.when(t.endswith(s) & (F.octet_length(t) > len(s) + 3), F.substr(t, F.lit(1), F.length(t) - len(s))).otherwise(out)
    return out


def event_terms(c: Column) -> Column:
    """Distinct normalised words of three or more characters that aren't stop words, in order."""
    tokens = F.filter(words_of(c, r"[\p{L}\p{N}']+"), lambda t: F.length(t) >= 3)
    return F.array_distinct(F.filter(F.transform(tokens, normalize_event_token), lambda t: ~t.isin(*TEMPORAL_STOPWORDS)))


def graph_terms(c: Column) -> Column:
    tokens = F.filter(words_of(c), lambda t: F.length(t) >= 3)
    return F.array_distinct(F.transform(tokens, normalize_event_token))


def reflection_terms(c: Column) -> Column:
    """Sorted distinct lower-case words of three or more bytes without stop words."""
    tokens = F.filter(F.transform(words_of(c), F.lower), lambda t: (F.octet_length(t) >= 3) & ~t.isin(*TERM_STOPWORDS))
    return F.sort_array(F.array_distinct(tokens))  # by the natural order, without a function that compares


def source_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(words_of(c), F.lower), lambda t: (F.length(t) >= 4) & ~t.isin(*SOURCE_STOPWORDS)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two term sets; an empty one shares nothing."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(overlap(a, b) / F.size(F.array_union(a, b)))


def query_entities(c: Column) -> Column:
    """Capitalised words of three or more characters, the first of each spelling."""
    found = F.filter(words_of(c), lambda t: (F.length(t) >= 3) & t.rlike(r"^\p{Lu}"))
    lower = F.transform(found, F.lower)
    return F.filter(found, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1)


def named_entities(c: Column) -> Column:
    return F.filter(query_entities(c), lambda t: ~F.lower(t).isin(*QUESTION_WORDS))


def any_of(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def is_temporal(c: Column) -> Column:
    q = F.lower(strip(c))
    return (q != "") & (q.startswith("when ") | any_of(q, TEMPORAL_CUES))


def is_multi_hop(c: Column) -> Column:
    return any_of(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), MULTI_HOP_CUES) | (F.size(named_entities(c)) >= 2)


def route(c: Column) -> Column:
    return (
        F.when(is_temporal(c), "temporal")
        .when(is_multi_hop(c), "multi_hop")
        .when((F.size(named_entities(c)) == 0) & (F.size(event_terms(c)) <= 3), "open_domain")
        .otherwise("single_hop")
    )


def years(c: Column) -> Column:
    """Four-digit runs from 1900 to 2099."""
    return F.filter(F.regexp_extract_all(c, F.lit("(?<![0-9])([0-9]{4})(?![0-9])"), 1), lambda y: y.between("1900", "2099"))


def normalize_graph_text(c: Column) -> Column:
    return F.array_join(F.transform(words_of(c), F.lower), " ")


def normalize_relation(c: Column) -> Column:
    return F.replace(normalize_graph_text(c), F.lit(" "), F.lit("_"))


def is_current_state(relation: Column) -> Column:
    return relation.startswith("current_") | relation.isin(*CURRENT_STATE)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_namespace(c: Column) -> Column:
    c = strip(c)
    return F.when(F.coalesce(c, F.lit("")) == "", "local").otherwise(F.regexp_replace(c, r"[\p{Cntrl}\s]", "_"))


def clamp(c: Column, known, default: str) -> Column:
    c = F.lower(strip(c))
    return F.when(c.isin(*known), c).otherwise(default)


def clamp_kind(c: Column) -> Column:
    return clamp(c, MEMORY_KINDS, "session")


def clamp_scope(c: Column) -> Column:
    return clamp(c, ("user",), "project")


def space_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(space_words(c))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.floor((word_count(c) * 4 + 2) / 3), F.lit(1)).cast("long")


def clip_words(c: Column, most: int) -> Column:
    w = space_words(c)
    return F.when(F.size(w) <= most, F.trim(c)).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("...")))


def chunk_summary(c: Column, density: Column) -> Column:
    return F.when(density == "high", clip_words(c, 90)).when(density == "medium", clip_words(c, 48)).otherwise(clip_words(c, 24))


def truncate_bytes(c: Column, most: int, mark: str = "… [truncated]") -> Column:
    """At most so many bytes, cut between characters, with a mark if anything was cut."""
    part = lambda n: F.substr(c.cast("binary"), F.lit(1), F.lit(max(n, 0))).cast("string")
    whole = F.coalesce(*[F.when(F.is_valid_utf8(part(most - k)), part(most - k)) for k in range(4)])
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(whole, F.lit(mark)))
