"""Fill-in-the-middle: texts are cut at unit boundaries that bit operations on big integers find, and put in another order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import pick

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of the others so many begin with their suffix.
PLAIN, SPM = 10, 20
#: Bytes of text whose results go on together.
TOGETHER = 8 << 20


def _table(chars: bytes) -> bytes:
    """Maps each byte of UTF-8 to '1' if it is one of chars, else to '0'."""
    return bytes(b"01"[b in chars] for b in range(256))


LEAD = _table(bytes([*range(0x80), *range(0xC0, 0x100)]))
SPACE = _table(b"\x20\t\n\v\f\r")
NEWLINE = _table(b"\n")


def mask(text: bytes, table: bytes) -> int:
    """One bit a byte, the first byte's the lowest: set where the table says '1'."""
    return int(text[::-1].translate(table), 2) if text else 0


def starts(text: bytes, unit: str) -> int:
    """The bits of the bytes at which units begin.

    char: code points. word: runs of other than ASCII white space, each with the space behind it. line: up to and with a newline.
    The first unit also has what stands before it, so that units cover the text.
    """
    first = 1 if text else 0
    if unit == "char":
        return mask(text, LEAD)
    if unit == "line":
        return (mask(text, NEWLINE) << 1 | first) & ((1 << len(text)) - 1)
    space = mask(text, SPACE)
    words = ~space & (space << 1 | first) & ((1 << len(text)) - 1)
    return words & (words - 1) | first if words else first


def select(bits: int, width: int, ranks: list[int]) -> list[int]:
    """The places of the set bits with the ranks (from 0, ascending), by halving; a rank beyond the last gives the width."""
    if not ranks:
        return []
    if width <= 64:
        out = []
        for rank in ranks:
            rest = bits
            for _ in range(rank):
                rest &= rest - 1
            out.append((rest & -rest).bit_length() - 1 if rest else width)
        return out
    half = width >> 1
    low = bits & ((1 << half) - 1)
    n = low.bit_count()
    out = select(low, half, [r for r in ranks if r < n])
    if above := [r - n for r in ranks if r >= n]:
        out += [half + x for x in select(bits >> half, width - half, above)]
    return out


def cut(text: bytes, unit: str, r1: int, r2: int) -> tuple[int, int, int, int, int]:
    """n units, and of the two cuts (r1 and r2 modulo n + 1, the smaller first) the units and bytes before them."""
    bits = starts(text, unit)
    n = bits.bit_count()
    a, b = sorted((r1 % (n + 1), r2 % (n + 1)))
    at, to = select(bits, len(text), [a, b])
    return n, a, b, at if a else 0, to if b else 0


def transform(docs: DataFrame, seed: str = "1", unit: str = "char") -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null if plain), output of every whole text of docs (doc_id, text).

    The choices follow from the sha256 of the seed, ':' and the decimal id. plain: texts that are empty, have a marker in them, or
    are drawn so. Null texts are empty ones, a null id is drawn as an empty id, repeated rows give equal results, extra columns
    are left out, and an empty table gives no rows.
    """
    docs = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *[group(i).alias(f"h{i + 1}") for i in range(4)])
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def made(text: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        n, a, b, at, to = cut(text, unit, h1, h2)
        if not text or p in text or s in text or m in text or h3 % 100 >= 100 - PLAIN:
            return n, "plain", None, None, text
        if h4 % 100 < SPM:
            return n, "spm", a, b - a, b"".join((s, text[to:], p, text[:at], m, text[at:to]))
        return n, "psm", a, b - a, b"".join((p, text[:at], s, text[to:], m, text[at:to]))

    names = ["n", "form", "prefix_units", "middle_units", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            out, first, size = [], 0, 0
            draws = [batch.column(f"h{i}").to_pylist() for i in range(1, 5)]
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                out.append(made(text, *[h[i] for h in draws]))
                size += len(text)
                if size >= TOGETHER or i + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(out)), *columns], ["doc_id", *names])
                    out, first, size = [], i + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, output binary")
    return done.withColumn("output", F.col("output").cast("string"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. The first markers are the made ones, as such texts have none of their own."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    after = lambda x, marker: F.substr(x, F.char_length(F.substring_index(x, marker, 1)) + len(marker) + 1)
    psm = [F.substring_index(body, SUFFIX, 1), after(body, MIDDLE), F.substring_index(after(body, SUFFIX), MIDDLE, 1)]
    spm = [F.substring_index(after(body, PREFIX), MIDDLE, 1), after(body, MIDDLE), F.substring_index(body, PREFIX, 1)]
    return F.when(form == "psm", F.concat(*psm)).when(form == "spm", F.concat(*spm)).otherwise(output)
