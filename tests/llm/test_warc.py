import hashlib

import duckdb
import pytest
import zstandard

from crestline.llm import warc as W
from crestline.llm.queries import ORACLE_SQL, QUERIES

ROWS = [
    (1, "http://a/", "x" * 200), (2, "u", "x" * 200), (3, None, "x" * 200), (1, "u", "x" * 200), (7, "u", None), (8, "u", ""), (9, "é \n", "é" * 60), (4, "u", "é" * 60),
    (5, "u", "a" * 99), (6, "u", "a" * 99), (20, "u", "<p>\r\n\r\n</p>" * 20_000),
]


def test_round_trip_against_sql(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = sorted(map(tuple, W.archive_round_trip(df).collect()), key=str)
    c = duckdb.connect()
    c.execute("create table pages(page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", ROWS)
    assert got == sorted(c.sql(ORACLE_SQL["op2_warc_archives"]).fetchall(), key=str)


def test_nulls_extra_columns_and_empty(spark):
    rows = [(None, "u", "y" * 150, "k"), (None, "u", "y" * 150, "k"), (30, "u", "y" * 150, "k"), (None, None, None, None), (None, "u", "z" * 150, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.archive_round_trip(df).collect()), key=str)
    assert got == sorted([(None, 150, "revisit", 30)] * 2 + [(30, 150, "response", None), (None, 0, "response", None), (None, 150, "response", None)], key=str)
    assert W.archive_round_trip(df.limit(0)).count() == 0


def test_many_archives_and_payloads(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html>page {i} " + "text " * i) for i in range(300)], "page_id long, url string, html string")
    archives = W.write_archives(df.coalesce(2), archive_bytes=4096)
    assert archives.count() > 4
    found = W.read_archives(archives, batch_records=7).collect()
    assert {(r.page_id, r.payload.decode(), r.url) for r in found} == {(r.page_id, r.html, r.url) for r in df.collect()}


def archive(records, samples=None):
    writer = W.ArchiveWriter(samples or [f"WARC/1.1 sample {i} ".encode() * 90 for i in range(64)])
    for r in records:
        writer.add(r)
    return writer, writer.content()


def record(i, body=b"hello"):
    return W.record_bytes(i, "http://x/", body, hashlib.sha256(body).hexdigest(), None)


def test_format():
    writer, data = archive([record(1), record(2, b"")])
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D and writer.dictionary
    assert int.from_bytes(data[4:8], "little") == len(writer.dictionary)
    assert list(W.archive_records(data)) == [record(1), record(2, b"")]
    # a dictionary that is itself compressed, and an archive without one
    packed = zstandard.ZstdCompressor().compress(writer.dictionary)
    own = data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + len(writer.dictionary) :]
    assert list(W.archive_records(own)) == [record(1), record(2, b"")]
    plain, bare = W.ArchiveWriter([]), [record(3), record(4)]
    for r in bare:
        plain.add(r)
    assert not plain.dictionary and list(W.archive_records(plain.content())) == bare
    assert list(W.archive_records(b"")) == []


def test_frames_without_a_size_and_of_many_blocks():
    big = bytes(range(256)) * 4000
    streamed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    frame = streamed.compress(record(1, big)) + streamed.flush()
    data = frame + zstandard.ZstdCompressor(write_checksum=True).compress(record(2, b"\0" * 500_000))
    assert [W.parse_record(r)["payload_bytes"] for r in W.archive_records(data)] == [len(big), 500_000]


def test_damage(spark):
    _, data = archive([record(i, b"body %d " % i * 50) for i in range(5)])
    flipped = bytearray(data)
    flipped[-6] ^= 255
    cut = data[:-10]
    rows = [("flipped", bytes(flipped)), ("cut", cut), ("junk", b"not an archive"), ("none", None), ("dictionary", data[:100])]
    found = W.read_archives(spark.createDataFrame(rows, "archive_id string, content binary")).collect()
    good = {a: sum(r.error is None for r in found if r.archive_id == a) for a in ("flipped", "cut", "junk", "none", "dictionary")}
    assert good == {"flipped": 4, "cut": 4, "junk": 0, "none": 0, "dictionary": 0}
    assert all(any(r.error for r in found if r.archive_id == a) for a in ("flipped", "cut", "junk", "dictionary"))


@pytest.mark.parametrize(
    "spoil",
    [
        lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"), lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: r.replace(b"hello", b"jello"),
        lambda r: r[:-1], lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"), lambda r: r.replace(b"WARC-Date:", b"WARC-Date"), lambda r: r.replace(b"Content-Length: 5", b"Content-Length: x"),
    ],
)
def test_invalid_records(spoil):
    with pytest.raises(ValueError):
        W.parse_record(spoil(record(1)))


def test_query(spark, sf):
    got = QUERIES["op2_warc_archives"](spark, sf).collect()
    want = duckdb.sql(ORACLE_SQL["op2_warc_archives"].replace("from pages", f"from '{sf}/pages.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
