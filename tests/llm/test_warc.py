import hashlib
import struct
from collections import defaultdict

import pytest
import zstandard

from loreweave.llm import queries, warc

PAGES = "page_id long, url string, html string, digest string, Payload int, archive string"
LONG = "<p>" + "same words again " * 100


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1, None) for i, u, h in rows], PAGES)


def plain(rows, least=1000):
    """The contract, row by row."""
    last = defaultdict(lambda: None)
    for i, _, h in rows:
        h = (h or "").encode()
        if len(h) >= least and i is not None and (last[h] is None or i > last[h]):
            last[h] = i
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        to = last[h] if last[h] != i else None
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def back(spark, pages, path, **kw):
    warc.write(pages, path, **kw)
    r = warc.read(spark, path)
    return r.select(warc.page_of(r.record_id).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(r.refers_to).alias("refers_to"))


ODD = [
    (1, "http://a/1", LONG), (2, None, LONG), (3, "http://a/ x\r\nWARC-Type: fake", LONG), (3, "http://b", LONG), (4, "u", None), (5, "u", ""), (6, "u", "x" * 999),
    (7, "u", "x" * 999), (8, "u", "é" * 500), (9, "u", "é" * 500), (None, "u", LONG), (None, None, None), (None, "u", "y" * 2000), (None, "u", "y" * 2000), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 200),
    (11, "u", "long " * 400_000), (12, "u", "a\x00b" * 700), (-5, "u", "a\x00b" * 700),
]


def test_odd_pages(spark, tmp_path):
    got = back(spark, pages_of(spark, ODD), f"{tmp_path}/w").collect()
    assert sorted(map(tuple, got), key=str) == plain(ODD)
    texts = {(r.record_id, r.payload_digest): bytes(r.payload).decode() for r in warc.read(spark, f"{tmp_path}/w").where("record_type = 'response'").collect()}
    assert texts["<urn:page:11>", hashlib.sha1(("long " * 400_000).encode()).hexdigest()] == "long " * 400_000
    assert {r.url for r in warc.read(spark, f"{tmp_path}/w").where("record_id = '<urn:page:3>'").collect()} == {"http://a/%20x%0D%0AWARC-Type:%20fake", "http://b"}


def test_empty_table(spark, tmp_path):
    assert back(spark, pages_of(spark, []), f"{tmp_path}/w").count() == 0


def test_whole_table_in_small_archives(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    got = back(spark, pages, f"{tmp_path}/w", most=20_000)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/w").collect()
    assert len(files) > 3 and all(f.length < 200_000 for f in files)
    rows = warc.payloads(pages)
    dictionary = warc.dictionary(rows, rows.selectExpr("page_id", "digest", "octet_length(payload) AS size"))
    for f in files:  # the file is a dictionary and frames that any decoder reads: one record each
        data = bytes(f.content)
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D and zstandard.ZstdDecompressor().decompressobj().decompress(data[8 : 8 + size]) == dictionary
        whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).stream_reader(data[8 + size :], read_across_frames=True).read()
        records = [c for _, c in warc.frames(data)]
        assert b"".join(records) == whole and all(c.startswith(b"WARC/1.1\r\n") and c.endswith(b"\r\n\r\n") for c in records)


def good():
    return warc.record(1, "http://a", b"hello", hashlib.sha1(b"hello").hexdigest(), None, "2024-01-01T00:00:00Z")


def test_records_of_others():
    assert warc.parse(good())["payload"] == b"hello"
    plain = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nX-Long: a\r\n  b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    r = warc.parse(plain)
    assert (r["record_type"], r["payload"], r["payload_bytes"], r["refers_to"]) == ("resource", b"abc", 3, None)


@pytest.mark.parametrize(
    "old, new, says",
    [
        (b"WARC/1.1", b"WARC/9.9", "version"),
        (b"WARC-Type: response\r\n", b"", "WARC-Type is missing"),
        (b"WARC-Date: 2024-01-01T00:00:00Z", b"WARC-Date 2024", "no field"),
        (b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 5\r\n\r\nhell", "isn't one record"),
        (b"hello", b"jello", "digest"),
        (b"Content-Length: 5\r\n", b"Content-Length: 4\r\n", "payload of 4"),
        (b"Content-Length: 5\r\n", b"Content-Length: x\r\n", "no length"),
        (b"hello\r\n\r\n", b"hello\r\n\n\n", "isn't one record"),
        (b"sha1:", b"sha1:1", "no digest"),
        (b"WARC-Type: response", b"WARC-Type: revisit", "revisit"),
    ],
)
def test_bad_records(old, new, says):
    assert old in good()
    with pytest.raises(warc.WarcError, match=says):
        warc.parse(good().replace(old, new))


def test_bad_archives(spark, tmp_path):
    c = zstandard.ZstdCompressor()
    frame, bad = c.compress(good()), c.compress(good().replace(b"hello", b"jello"))
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert [x for _, x in warc.frames(skip + frame + skip + frame)] == [good(), good()]
    raw = struct.pack("<II", warc.DICTIONARY_MAGIC, 9) + b"123456789"
    assert len(list(warc.frames(raw))) == 0
    for data in (frame[:-2], frame + b"1234", skip[:-1], frame + raw, frame + b"\x00" * 20):
        with pytest.raises(warc.WarcError):
            list(warc.frames(data))
    for i, data in enumerate((frame + bad + frame, frame[:-1], frame)):
        (tmp_path / f"{i}.warc.zst").write_bytes(data)
    rows = warc.read(spark, f"file://{tmp_path}", strict=False).collect()
    assert sorted((r.archive[-10:], r.error is None) for r in rows) == [("0.warc.zst", False), ("0.warc.zst", True), ("0.warc.zst", True), ("1.warc.zst", False), ("2.warc.zst", True)]
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"file://{tmp_path}/0.warc.zst").count()


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op11_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
