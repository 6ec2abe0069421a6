"""WARC archives in Zstandard: one frame per record, one dictionary per archive in a leading skippable frame.

An archive is a row (archive_id, content) of a Parquet table in the cluster's shared folder, committed by Spark like any
table: no executor writes outside it, and a lost executor's archives are simply written again. The reader takes the
same two columns from anywhere, so files read with ``spark.read.format("binaryFile")`` work as well.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import byte_texts, materialise

MIN_REVISIT = 100
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
SAMPLE_RECORDS = 64
SAMPLE_BYTES = 1 << 20
#: a value of a table has at most 2 GiB, so no record that was written is larger; a larger claim is damage
MAX_RECORD = (1 << 31) + (1 << 20)
#: Magic numbers of skippable frames (sixteen from the first), of frames and of dictionaries.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A50, 0xFD2FB528, 0xEC30A437
_WARC_SKIPPABLE = 0x184D2A5D
_DATE = "1970-01-01T00:00:00Z"
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit carries no payload, only the digest, length and id of what it repeats."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {''.join(c if ' ' < c < chr(127) else ''.join(f'%{b:02X}' for b in c.encode()) for c in url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html;charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload facts of one record; ValueError says what is wrong with it."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header line {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [x for x in _REQUIRED if x.lower() not in headers]:
        raise ValueError(f"{missing[0]} is missing")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length does not fit the record")
    body, kind = rest[:-4], headers["warc-type"]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    refers = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    if kind == "response":
        own = hashlib.sha256(body).hexdigest()
        if digest and digest != own:
            raise ValueError("payload digest does not fit the payload")
        digest, size = own, len(body)
    elif kind == "revisit":
        if not refers.lstrip("-").isdigit() or body or not headers.get("x-payload-length", "").isdigit():
            raise ValueError("revisit without a target, or with a payload")
        size = int(headers["x-payload-length"])
    else:
        size = len(body)
    page = headers["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    return {
        "page_id": int(page) if page.lstrip("-").isdigit() else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": int(refers) if refers and kind == "revisit" else None, "url": headers.get("warc-target-uri"), "payload": body if kind == "response" else None,
    }


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or none if the samples are too few or too uniform for one."""
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Frames of one archive. The dictionary is trained on the first records, a bounded number of them."""

    def __init__(self, samples: list[bytes]):
        self.dictionary = _dictionary(samples)
        data = zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None
        self._coder = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True, write_content_size=True)
        self.restart()

    def restart(self) -> None:
        self.parts = [struct.pack("<II", _WARC_SKIPPABLE, len(self.dictionary)) + self.dictionary] if self.dictionary else []
        self.size = sum(map(len, self.parts))

    def add(self, record: bytes) -> None:
        self.parts.append(self._coder.compress(record))
        self.size += len(self.parts[-1])

    def content(self) -> bytes:
        return b"".join(self.parts)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its block headers alone."""
    if len(data) < at + 6:
        raise ValueError("truncated frame")
    parameters = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    pos = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if pos + 3 > len(data):
            raise ValueError("truncated frame")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * bool(parameters.has_checksum)
    if pos > len(data):
        raise ValueError("truncated frame")
    return pos


def _decoded(decoder: zstandard.ZstdDecompressor, frame: bytes) -> bytes:
    """A frame that does not say its size, piece by piece, so that no more memory is taken than it needs."""
    out, total = [], 0
    with decoder.stream_reader(frame) as reader:
        while part := reader.read(1 << 20):
            total += len(part)
            if total > MAX_RECORD:
                raise ValueError("record is too large")
            out.append(part)
    return b"".join(out)


def archive_records(content: bytes) -> Iterator[bytes | ValueError]:
    """The records of an archive in order; a frame that cannot be decoded gives the error in its place.

    After a frame whose end cannot be found nothing more can be read; that is one error as well.
    """
    data, at, dictionary, first = memoryview(content), 0, None, True
    decoder = zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & ~0xF == SKIPPABLE:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + size > len(data):
                yield ValueError("truncated skippable frame")
                return
            if first:
                raw = bytes(data[at + 8 : at + 8 + size])
                if int.from_bytes(raw[:4], "little") == FRAME:
                    raw = _decoded(zstandard.ZstdDecompressor(), raw)
                dictionary = zstandard.ZstdCompressionDict(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
            at, first = at + 8 + size, False
            continue
        first = False
        try:
            if magic != FRAME:
                raise ValueError("no Zstandard frame")
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield ValueError(str(e))
            return
        try:
            frame = bytes(data[at:end])
            size = zstandard.frame_content_size(frame)
            if size > MAX_RECORD:
                raise ValueError("record is too large")
            yield decoder.decompress(frame) if size >= 0 else _decoded(decoder, frame)
        except (ValueError, zstandard.ZstdError) as e:
            yield ValueError(str(e))
        at = end


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record for each row of (page_id, url, html) and return the table of archives (archive_id, content).

    Of rows with equal payloads of at least min_revisit bytes the one with the smallest page_id is a response and the
    others revisit it; rows that repeat that page_id are responses too, and so is a row whose id is null unless another
    row has one. A null html is an empty payload. Digests are taken in the JVM; only payloads that occur more than once
    take part in the join, which AQE splits at a payload that many pages share.
    """
    bare = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = bare.withColumn("digest", F.sha2("payload", 256))
    same = bare.where(F.octet_length("payload") >= min_revisit).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = materialise(same.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "payload-firsts")
    if first.isEmpty():
        marked = keyed.withColumn("first", F.lit(None).cast("long"))
    else:
        marked = keyed.join(first, "digest", "left").withColumn("first", F.expr("if(page_id is null or page_id <> first, first, null)"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, names = None, 0

        def flush() -> pa.RecordBatch:
            content = writer.content()
            name = hashlib.sha256(content).hexdigest()
            writer.restart()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive_id", "content"])

        for batch in batches:
            page, url, digest, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            payloads = byte_texts(batch.column(2))
            if writer is None and payloads:
                writer, room, samples = None, SAMPLE_BYTES, []
                for x in payloads[:SAMPLE_RECORDS]:
                    samples.append(x[: min(room, 1 << 16)])
                    room -= len(samples[-1])
                    if room <= 0:
                        break
                writer = ArchiveWriter([x for x in samples if len(x) >= 64])
            for row in zip(page, url, payloads, digest, refers, strict=True):
                writer.add(record_bytes(*row))
                names += 1
                if writer.size >= archive_bytes:
                    yield flush()
                    names = 0
        if writer is not None and names:
            yield flush()

    return materialise(marked.select("page_id", "url", "payload", "digest", "first").mapInArrow(write, "archive_id string, content binary"), "warc")


RECORD = "archive_id string, position long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"
_FIELDS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())


def read_archives(archives: DataFrame, with_payload: bool = True, batch_records: int = 512) -> DataFrame:
    """One row per record of (archive_id, content): the columns of RECORD; error says why a record could not be read.

    Each archive is decoded frame by frame, and rows leave in batches bounded by number and by bytes.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = (pa.string(), pa.int64(), *_TYPES, pa.string())
            names = ["archive_id", "position", *_FIELDS, "error"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        size = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for i, record in enumerate(archive_records(content.as_py() or b"")):
                    try:
                        if isinstance(record, ValueError):
                            raise record
                        found = parse_record(record)
                        if not with_payload:
                            found["payload"] = None
                        rows.append((name, i, *(found[k] for k in _FIELDS), None))
                    except ValueError as e:  # UnicodeDecodeError is one
                        rows.append((name, i, *[None] * len(_FIELDS), str(e)))
                    size += len(rows[-1][-2] or b"")
                    if len(rows) >= batch_records or size >= 16 << 20:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    return archives.select(F.col("archive_id").cast("string").alias("archive_id"), F.col("content").cast("binary").alias("content")).mapInArrow(scan, RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from archives."""
    found = read_archives(write_archives(pages), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", F.coalesce("record_type", F.raise_error(F.concat(F.lit("unreadable record: "), "error"))).alias("record_type"), "refers_to")
