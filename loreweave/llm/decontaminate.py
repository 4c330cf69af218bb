"""Benchmark decontamination by a generalised suffix automaton over the words of the test items.

Training texts stream through the automaton, which tracks the longest item factor that ends at each word. Where that
length reaches a window, the window's words are hit. Automata are built from bounded groups of items only; with several
groups, texts pass through one automaton after another within one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import by_place, cut, pick, release

WINDOW = 13
#: Contaminated: hit words are at least one in so many.
COVERAGE = 20
#: Bytes of item text in one automaton, and words of an item that stay together: neighbouring pieces of a longer item share
#: all words of a window but one, so that no window is lost.
GROUP_BYTES, PIECE_WORDS = 1_000_000, 4096
#: Bytes of document text that pass through one of several automata before the next is loaded.
PASS_BYTES = 32 << 20

#: A-Z to lower case, ASCII without letters and digits to blanks.
TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Automaton:
    """Words of the items as ids; states of the suffix automaton of all items; items by window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        texts = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if ids:
                texts.append((name, ids))
        for _, ids in texts:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.least = min([min(len(ids), window) for _, ids in texts], default=0)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)  # links before the states that have them
        #: For each state the one, itself or up its links, whose class has its suffix of a window's words; 0: it is shorter.
        self.window_of = [0] * len(self.link)
        for x in order:
            if self.length[x] >= window:
                self.window_of[x] = self.window_of[self.link[x]] or x
        #: State of a window's class: the items that have the window. State: (length, item) of whole short items.
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, ids in texts:
            at = 0
            for n, c in enumerate(ids, 1):
                at = self.next[at][c]
                if n >= window:
                    self.items.setdefault(self.window_of[at], set()).add(name)
            if len(ids) < window:
                self.short.setdefault(at, []).append((len(ids), name))
        #: For each state the nearest one, itself or up its links, that ends a short item; 0: none does.
        self.short_of = [0] * len(self.link)
        for x in order:
            self.short_of[x] = x if x in self.short else self.short_of[self.link[x]]

    def _copy(self, p: int, c: int, q: int) -> int:
        """Splits q for the strings of length[p] + 1 words."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def match(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of a text's words, merged and in order, and the items with occurring windows."""
        if len(found) < self.least or not self.least:
            return [], set()
        get, none = self.vocabulary.get, -1
        ids = np.fromiter((get(w, none) for w in found), np.int32, len(found))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        seen: set[int] = set()
        items: set[str] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a >= self.least:
                self._walk(ids[a:b].tolist(), a, spans, seen, items)
        return spans, items.union(*[self.items[x] for x in seen])

    def _walk(self, ids: list[int], base: int, spans: list, seen: set, items: set) -> None:
        nexts, links, lengths, window = self.next, self.link, self.length, self.window
        state = n = 0
        for i, c in enumerate(ids, base + 1):
            while state and c not in nexts[state]:
                state = links[state]
                n = lengths[state]
            if (to := nexts[state].get(c)) is not None:
                state, n = to, n + 1
            hit = 0
            if n >= window:
                hit = window
                seen.add(self.window_of[state])
            up = self.short_of[state] if n >= self.least else 0
            while up:  # at most one state for each length below a window's
                for m, name in self.short[up]:
                    if m <= n:
                        hit = max(hit, m)
                        items.add(name)
                up = self.short_of[links[up]]
            if hit:
                if spans and spans[-1][1] >= i - hit:
                    start = spans[-1][0]
                    while spans and spans[-1][1] >= i - hit:
                        start = min(start, spans.pop()[0])
                    spans.append((min(start, i - hit), i))
                else:
                    spans.append((i - hit, i))


def _pieces(window: int):
    """Items as words in pieces."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column("i").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ws = words(text)
                step = max(1, PIECE_WORDS - window + 1)
                for at in range(0, max(1, len(ws) - window + 1), step):
                    names.append(name)
                    texts.append(b" ".join(ws[at : at + step + window - 1]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["i", "text"])

    return run


def _build(window: int):
    """One row per group, which come one after another: its pickled automaton."""

    def run(batches):
        group, held = None, []

        def built():
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Automaton(sorted(held), window), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["automaton"])

        for batch in batches:
            for g, name, text in zip(*[batch.column(c).to_pylist() for c in ("g", "i", "text")], strict=True):
                if g != group and held:
                    yield built()
                    held = []
                group = g
                held.append((name, text))
        if held:
            yield built()

    return run


def automata_of(benchmark: DataFrame, window: int = WINDOW, most: int = GROUP_BYTES) -> list:
    """Broadcasts of pickled automata of the items, each of about `most` bytes of text. Null ids count as empty ones.

    One group is built here; several are built by tasks and come to the driver one at a time.
    """
    spark = benchmark.sparkSession
    items = pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").where("text is not null")
    pieces = items.mapInArrow(_pieces(window), "i string, text string")
    n = 1 + pieces.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // most
    if n == 1:
        return [spark.sparkContext.broadcast(pickle.dumps(Automaton(sorted(map(tuple, pieces.collect())), window), pickle.HIGHEST_PROTOCOL))]
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("i", "text"), F.lit(n))).repartition(n, "g").sortWithinPartitions("g")
    built = cut(grouped.mapInArrow(_build(window), "automaton binary"), "automata")
    return [spark.sparkContext.broadcast(bytes(r[0])) for r in built.toLocalIterator()]


class Matcher:
    """Finds the hits of texts; of several automata a task holds one at a time."""

    def __init__(self, shared: list):
        release()
        self.shared = shared
        self.only = pickle.loads(shared[0].value) if len(shared) == 1 else None

    def _automata(self) -> Iterator[Automaton]:
        if self.only is not None:
            yield self.only
            return
        for x in self.shared:
            a = pickle.loads(x.value)
            vars(x).pop("_value", None)  # what the broadcast would keep in this worker; its file stays
            yield a

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Of each text the number of words, the hit spans, merged and in order, and the items."""
        sizes: list[int] = [0] * len(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for a in self._automata():
            for i, text in enumerate(texts):
                ws = words(text)
                sizes[i] = len(ws)
                got, names = a.match(ws)
                if got:
                    spans[i] = merged(spans[i] + got) if spans[i] else got
                    items[i] |= names
        return sizes, spans, items

    def passes(self, batches) -> Iterator[pa.RecordBatch]:
        """The batches; with several automata those of at most PASS_BYTES of text, or one, are joined."""
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("text").nbytes
            if self.only is not None or size >= PASS_BYTES:
                yield from _joined(held)
                held, size = [], 0
        yield from _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if len(batches) > 1 else batches


MATCHES = "n_words long, spans array<struct<start:int,end:int>>, item_ids array<string>"


def _matches(shared: list, kept: list[str]) -> Callable:
    def run(batches):
        find = Matcher(shared)
        for batch in find.passes(batches):
            sizes, spans, items = find(batch.column("text").to_pylist())
            cells = [[{"start": s, "end": e} for s, e in got] for got in spans]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(map(sorted, items), pa.list_(pa.string()))],
                [*kept, "n_words", "spans", "item_ids"],
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The columns `keep` of docs (text and more) with n_words, spans (hit words, from start to before end, merged) and item_ids (sorted strings).

    Whole texts are matched; null and empty texts have no words and no spans. Items without words match nothing; repeated
    items count once. No items: no spans. Rows with one id twice are matched each on its own. Texts are read once, whatever
    the number of items, and never written.
    """
    docs = pick(docs, *dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep) + ", " + MATCHES
    return docs.mapInArrow(_matches(automata_of(benchmark, window, group_bytes), [c for c in docs.columns if c in keep]), schema)


def judged(matches: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    """n_hit, n_items and contaminated: at least one word in `coverage` is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return matches.withColumns({"n_hit": n_hit, "n_items": F.size("item_ids").cast("long")}).withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """docs (text and more) without contaminated rows, whose hit words are over the coverage limit; hit spans of the others are cut out.

    Where what a cut brings together is a window, it is cut out as well. n_chars, if there, is counted anew for texts with cuts.
    Other columns and texts without hits stay as they are; null and empty texts have no hits. No items: all stays.
    """
    names, docs = docs.columns, by_place(docs, "text", "n_chars")
    shared = automata_of(benchmark, window, group_bytes)

    def run(batches):
        find = Matcher(shared)
        for batch in find.passes(batches):
            texts = batch.column("text").to_pylist()
            sizes, spans, _ = find(texts)
            hits = [sum(e - s for s, e in x) for x in spans]
            clean = [not h or coverage * h < n for h, n in zip(hits, sizes, strict=True)]
            left = [i for i, h in enumerate(hits) if h and clean[i]]
            if left:
                found = {i: spans[i] for i in left}
                while found:
                    for i, x in found.items():
                        texts[i] = cut_spans(texts[i], x)
                    _, again, _ = find([texts[i] for i in found])
                    found = {i: x for i, x in zip(found, again, strict=True) if x}
                batch = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
                at = batch.schema.get_field_index("n_chars")
                if at >= 0:
                    counts = batch.column(at).to_pylist()
                    for i in left:
                        counts[i] = len(texts[i])
                    batch = batch.set_column(at, "n_chars", pa.array(counts, batch.schema.field(at).type))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).toDF(*names)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from each span's first word to its last; a line break stays at each cut."""
    raw = text.encode("utf-8", "surrogatepass")
    plain, at, ends = raw.translate(TABLE), 0, []
    for w in plain.split():
        at = plain.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    out, here = [], 0
    for s, e in spans:
        out += [raw[here : ends[s][0]], b"\n"]
        here = ends[e - 1][1]
    return b"".join([*out, raw[here:]]).decode("utf-8", "surrogatepass")
