"""WARC archives in Zstandard with a dictionary (operator 8): writing and reading back.

An archive is a skippable frame holding the dictionary, then one frame for each record.
Archives are written by Spark's own text writer, so they go through its commit protocol to
any file system Spark can reach; the line separator it needs is an empty skippable frame,
which every Zstandard reader passes over.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, read, shared_dir

#: Fixed values of the formats: frame magic numbers and record types.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored in full.
LEAST_BYTES = 1000
#: Pieces into which the copies of one payload are dealt.
SALTS = 16
#: The dictionary of an archive is trained on its first records up to this many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
DATE = "1970-01-01T00:00:00Z"
_URN = "urn:x-page:"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit of an equal one without it."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary for these records; their own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or VERSION


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The archive of these records, frame by frame."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not held:
        return
    words = train(held)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words
    # A raw dictionary has no number of its own, so frames name none and any reader accepts them.
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    for r in held:
        yield coder.compress(r)
    held.clear()
    for r in records:
        yield coder.compress(r)


class ArchiveError(ValueError):
    """The archive or a record of it breaks the format."""


def read_frames(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame each, by the dictionary in its leading frame."""
    view, at, decoder = memoryview(data), 0, None
    while at < len(view):
        if len(view) - at < 8:
            raise ArchiveError("a frame is cut short")
        magic, size = struct.unpack_from("<II", view, at)
        if magic in SKIPPABLE:
            if at + 8 + size > len(view):
                raise ArchiveError("a skippable frame is cut short")
            if at == 0 and magic == DICTIONARY_MAGIC:
                words = bytes(view[8 : 8 + size])
                if words.startswith(FRAME_MAGIC):  # the dictionary may be compressed itself
                    words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            at += 8 + size
            continue
        frame, out = (decoder or zstandard.ZstdDecompressor()).decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ArchiveError("a frame is cut short")
            part = view[at : at + step]
            try:
                out.append(frame.decompress(part))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a frame can't be decoded: {e}") from e
            at += len(part) - len(frame.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """The fields of a record whose headers, lengths and digest hold; ``ArchiveError`` if not."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise ArchiveError("not a WARC record")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ArchiveError(f"not a header: {line[:60]!r}")
        fields[name.strip().lower().decode()] = value.strip().decode()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ArchiveError(f"headers missing: {sorted(missing)}")
    length = int(fields["content-length"]) if fields["content-length"].isdecimal() else -1
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length isn't the block's length")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [x.partition(b":")[2].strip() for x in io.BytesIO(http) if x.lower().startswith(b"content-length:")]
    if not gap or not http.startswith(b"HTTP/") or not sizes or not sizes[0].isdigit():
        raise ArchiveError("not an HTTP response")
    kind, stated = fields["warc-type"], base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda key: int(x) if (x := fields[key].strip("<>").removeprefix(_URN)) else None
    if kind == "response" and (len(payload) != int(sizes[0]) or hashlib.sha1(payload).hexdigest() != stated):
        raise ArchiveError("the payload isn't the one its headers state")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ArchiveError("a revisit holds no payload and names its response")
    return {
        "page_id": number("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "payload": payload,
        "payload_bytes": int(sizes[0]),
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": number("warc-refers-to") if kind == "revisit" else None,
    }


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload and, where a later equal payload is stored, the id to refer to.

    Only payloads of at least ``least`` bytes count.  Copies are found by digest and length,
    counted before they are shuffled; those of one payload are then dealt over ``SALTS``
    pieces, so that no task gets all copies of one page.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "utf-8")))).withColumn("size", F.octet_length("html"))
    large = rows.filter(F.col("size") >= least)
    copies = large.groupBy("digest", "size").agg(F.max("page_id").alias("stored"), F.count("*").alias("n")).filter("n > 1")
    copies = copies.select("digest", "size", "stored", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rows = rows.join(copies, ["digest", "size", "salt"], "left")
    refers = F.when(F.col("stored") != F.coalesce(F.col("page_id"), F.lit(-1)), F.col("stored"))
    return rows.select("page_id", "url", F.encode("html", "utf-8").alias("payload"), refers.cast("bigint").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Writes pages(page_id, url, html) as archives, one for each partition.

    A null html is an empty payload and a null url no target; rows which repeat an id are
    records of their own; other columns aren't read; an empty table writes no record.
    """

    def run(batches):
        import pyarrow as pa

        def records():
            for b in batches:
                for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    yield record(*row)

        out, size = [], 0
        for frame in frames(records()):
            out.append(frame)
            size += len(frame)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = with_revisits(pages, least).select(F.col("page_id").cast("bigint"), "url", "payload", "refers_to")
    made = map_arrow(rows, run, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("ascii")).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under a path; a record that breaks the format is an error."""
    schema = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in read_frames(content.as_py()):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size > 1 << 22:
                        yield make(rows)
                        rows, size = [], 0
                yield make(rows)

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), run, schema)


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), s AS (SELECT d, n, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN s.m IS NULL OR s.m = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.m <> p.page_id THEN s.m END AS refers_to
FROM p LEFT JOIN s ON p.d = s.d AND p.n = s.n
"""
