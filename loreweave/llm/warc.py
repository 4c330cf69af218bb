"""Web archives: WARC records in Zstandard, one frame a record, behind a skippable frame with the dictionary; writer and reader."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import cut, pick
from loreweave.llm.samples import place, threshold

# Fixed values of the formats: frames, the last (empty) block of a frame, record versions and fields.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
TAIL = b"\x01\x00\x00"
VERSIONS = ("WARC/1.0", "WARC/1.1")
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Compressed bytes after which a new archive begins. A reader holds one archive, and of it one record, at a time.
ARCHIVE = 16 << 20
#: The dictionary: its size, and the most samples and bytes a sample that it is trained on. It changes sizes, no result.
DICTIONARY, SAMPLES, SAMPLE = 64 << 10, 256, 128 << 10
LEVEL = 3
#: Bytes that a reader hands on, or feeds to the decoder, at a time.
TOGETHER, FED = 8 << 20, 64 << 10


class WarcError(ValueError):
    """A record or archive that breaks the format."""


def revisits(named: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest, refers_to of rows (page_id, digest, size) whose payload of `least` bytes or more a row with a larger id has too.

    refers_to is the largest id among the equal payloads. Of null ids none is the largest. Equal rows give one.
    """
    named = named.where(F.col("size") >= least).select("page_id", "digest")
    groups = named.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return named.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (bytes) and digest (hex SHA-1) of pages (page_id, url, html)."""
    pages = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return pages.withColumn("digest", F.sha1("payload"))


def dictionary(rows: DataFrame, named: DataFrame) -> bytes:
    """A dictionary for whole payloads of about SAMPLES rows of at most SAMPLE bytes, by a hash of their ids; empty if they are too few."""
    n, least = named.where(F.col("size").between(1, SAMPLE)).agg(F.count("*"), F.min(place("page_id", "digest", seed=11))).first()
    if n < 16:
        return b""
    some = rows.where((F.octet_length("payload").between(1, SAMPLE)) & (place("page_id", "digest", seed=11) < threshold(n, least, SAMPLES)))
    samples = [bytes(r.payload) for r in some.select("payload").orderBy("page_id", "digest").limit(2 * SAMPLES).collect()]
    if sum(map(len, samples)) < 8 * DICTIONARY or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # the samples have too little to learn from, or are all one
        return b""


def _frame(data: bytes, compressor: zstandard.ZstdCompressor) -> bytes:
    """One frame that ends in an empty block."""
    c = compressor.compressobj(size=len(data))
    frame = c.compress(data) + c.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) + c.flush(zstandard.COMPRESSOBJ_FLUSH_FINISH)
    if not frame.endswith(TAIL):
        raise WarcError("the compressor ended a frame in another way")
    return frame


def _leading(raw: bytes) -> bytes:
    packed = _frame(raw, zstandard.ZstdCompressor(level=LEVEL, write_checksum=False))
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def _identity(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or a revisit that has the HTTP head of the response but not its body."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = ["WARC-Type: response" if refers_to is None else "WARC-Type: revisit", f"WARC-Record-ID: {_identity(page_id)}", f"WARC-Date: {date}"]
    if url:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    fields.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is None:
        block += payload
    else:
        fields += [f"WARC-Refers-To: {_identity(refers_to)}", f"WARC-Profile: {SAME_PAYLOAD}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *fields, "", ""]).encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "2024-01-01T00:00:00Z", most: int = ARCHIVE) -> None:
    """Writes a record per row of pages (page_id, url, html), whole texts in UTF-8, to archives below path.

    Of equal payloads of `least` bytes or more, that with the largest id is the response, and the others are revisits that refer to
    it; rows with that id twice are a response each, rows with a null id refer to the others. Null and empty texts are empty
    payloads, a null url leaves its field out, extra columns are left out, an empty table gives no archive. A task begins a new
    archive after `most` compressed bytes. Spark's text writer puts the frames into files, byte for byte: its line separator
    is the empty block that ends each frame, so that files hold frames alone, and lost tasks are run again as for any table.
    Which rows are revisits is found from ids and digests alone; payloads are shuffled only to deal out a table of few splits.
    """
    spark, rows = pages.sparkSession, payloads(pages)
    named = cut(rows.select("page_id", "digest", F.octet_length("payload").alias("size")), "pages")
    shared = spark.sparkContext.broadcast(dictionary(rows, named))
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few splits: a small table
        rows = rows.repartition(spark.sparkContext.defaultParallelism, "page_id", "digest")
    r = revisits(named, least).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    rows = rows.join(r, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")

    def run(batches):
        raw = shared.value
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False)
        part, archive, written, place, size = TaskContext.get().partitionId(), -1, most, 0, 0
        out = []

        def batch_of(out):
            names, places, frames = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(places, pa.int64()), pa.array(frames, pa.binary())], ["archive", "place", "frame"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns, strict=True):
                frames = []
                if written >= most:
                    archive, written = archive + 1, 0
                    frames = [_leading(raw)] if raw else []
                frames.append(_frame(record(*(x.as_py() for x in row), date), compressor))
                for frame in frames:
                    out.append((f"{part:05d}-{archive:05d}.warc.zst", place, frame[: -len(TAIL)]))
                    written, size, place = written + len(frame), size + len(frame), place + 1
                if size >= TOGETHER:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    frames = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, place long, frame binary")
    lines = frames.sortWithinPartitions("archive", "place").select("archive", F.col("frame").cast("string").alias("value"))
    lines.write.partitionBy("archive").option("lineSep", TAIL.decode()).text(path)


# Reading


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each frame behind the leading dictionary, if there is one; other skippable frames are passed over."""
    view, at, known = memoryview(data), 0, None
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError(f"{len(data) - at} bytes at {at} are no frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) < size:
                raise WarcError(f"the skippable frame at {at} ends early")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise WarcError(f"a dictionary at {at}, not in front")
                if body[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                known = zstandard.ZstdCompressionDict(body)
            at += 8 + size
            continue
        decoder, begin, parts = zstandard.ZstdDecompressor(dict_data=known).decompressobj(), at, []
        try:
            while not decoder.eof and at < len(data):
                some = view[at : at + FED]
                parts.append(decoder.decompress(some))
                at += len(some) - (len(decoder.unused_data) if decoder.eof else 0)
        except zstandard.ZstdError as error:
            raise WarcError(f"the frame at {begin}: {error}") from error
        if not decoder.eof:
            raise WarcError(f"the frame at {begin} ends early")
        yield begin, b"".join(parts)


def _fields(head: bytes, what: str) -> tuple[str, dict[str, str]]:
    """The first line and the named fields of a head; a line that begins with a blank goes on with the field before."""
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", head.decode()).split("\r\n")
    except UnicodeDecodeError as error:
        raise WarcError(f"the {what} head is no UTF-8") from error
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"{line[:80]!r} is no field of the {what} head")
        out[name.strip().lower()] = value.strip()
    return lines[0], out


def _length(fields: dict[str, str], what: str) -> int:
    value = fields.get("content-length", "")
    if not value.isdecimal() or not value.isascii():
        raise WarcError(f"{value!r} is no length of a {what}")
    return int(value)


def parse(content: bytes) -> dict:
    """The record of a frame, its head, lengths and digest checked against what is there."""
    end = content.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("no end of the record's head")
    version, fields = _fields(content[:end], "record")
    if version not in VERSIONS:
        raise WarcError(f"{version[:40]!r} is no known version")
    for name in NEEDED:
        if not fields.get(name.lower()):
            raise WarcError(f"{name} is missing")
    size = _length(fields, "record")
    if len(content) != end + 4 + size + 4 or content[-4:] != b"\r\n\r\n":
        raise WarcError(f"a frame of {len(content)} bytes isn't one record with a block of {size}")
    block = content[end + 4 : end + 4 + size]
    out = {"record_type": fields["warc-type"], "record_id": fields["warc-record-id"], "date": fields["warc-date"], "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload": None, "payload_bytes": None, "payload_digest": None}
    if "warc-payload-digest" in fields:
        name, _, value = fields["warc-payload-digest"].partition(":")
        try:
            out["payload_digest"] = (value.lower() if len(value) == 40 else base64.b32decode(value).hex()) if name.lower() == "sha1" else None
        except ValueError as error:
            raise WarcError(f"{value[:40]!r} is no digest") from error
    if fields.get("content-type", "").startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        if end < 0:
            raise WarcError("no end of the HTTP head")
        _, http = _fields(block[:end], "HTTP")
        out["payload_bytes"] = _length(http, "payload") if "content-length" in http else None
        block = block[end + 4 :]
    if out["record_type"] == "revisit":
        if not out["refers_to"] or block:
            raise WarcError("a revisit without a record it refers to, or with a payload")
        return out
    if out["payload_bytes"] not in (None, len(block)):
        raise WarcError(f"{len(block)} bytes of a payload of {out['payload_bytes']}")
    digest = hashlib.sha1(block, usedforsecurity=False).hexdigest()
    if out["payload_digest"] not in (None, digest):
        raise WarcError(f"the payload's digest is {digest}, not {out['payload_digest']}")
    return out | {"payload": block, "payload_bytes": len(block), "payload_digest": digest}


FIELDS = {"archive": pa.string(), "place": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "date": pa.string(), "url": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(), "error": pa.string()}
SCHEMA = "archive string, place long, record_type string, record_id string, date string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def read(spark: SparkSession, path: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """The records of all archives below path: archive, place (its frame's offset), record_type, record_id, date, url, refers_to,
    payload_bytes, payload_digest (hex), payload, error.

    payload_bytes and payload_digest of a revisit are those it states of the whole payload. A bad record or archive fails the read,
    or if not strict is a row with an error (after a bad frame the rest of its archive can't be found). Without payloads they
    are checked but not handed on. Archives are read in parallel, each whole by one task. A folder without archives gives no rows.
    """

    def records(data: bytes) -> Iterator[tuple[int, dict]]:
        found = frames(data)
        while True:
            try:
                at, content = next(found)
            except StopIteration:
                return
            except WarcError as error:
                if strict:
                    raise
                yield -1, {"error": str(error)}
                return
            try:
                yield at, parse(content)
            except WarcError as error:
                if strict:
                    raise WarcError(f"the record at {at}: {error}") from error
                yield at, {"error": str(error)}

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], t) for c, t in FIELDS.items()], list(FIELDS))

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                out, size = [], 0
                for at, r in records(content.as_py()):
                    if not payloads:
                        r = r | {"payload": None}
                    out.append(r | {"archive": name.as_py(), "place": at})
                    size += len(r.get("payload") or b"") + 500
                    if size >= TOGETHER:
                        yield batch_of(out)
                        out, size = [], 0
                if out:
                    yield batch_of(out)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def page_of(identity: Column) -> Column:
    """The page_id in a record's id, null if it has none."""
    return F.regexp_extract(identity, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
