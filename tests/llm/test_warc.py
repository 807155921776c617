import hashlib
import struct

import pytest
import zstandard

from tamarack.llm import warc


def archive(records):
    return warc.EMPTY_FRAME.join(warc.frames(iter(records)))


def test_round_trip_and_dictionary():
    records = [warc.record(i, f"http://h/{i}", (b"<p>text %d</p>" % i) * 40, None) for i in range(300)] + [warc.record(7, "http://h/é x", b"", 3)]
    data = archive(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    back = list(warc.read_frames(data, step=1000))
    assert back == records
    assert warc.parse(back[5])["payload"] == b"<p>text 5</p>" * 40
    assert warc.parse(back[-1])["record_type"] == "revisit" and warc.parse(back[-1])["refers_to"] == 3


def test_compressed_dictionary():
    words = b"the dictionary of this archive " * 50
    packed = zstandard.ZstdCompressor().compress(words)
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    record = warc.record(1, None, b"the dictionary", None)
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + coder.compress(record)
    assert list(warc.read_frames(data)) == [record]


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"WARC?1.1"), lambda r: r.replace(b"hello", b"hullo"), lambda r: r[:-1], lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1")])
def test_broken_records(change):
    with pytest.raises(warc.ArchiveError):
        warc.parse(change(warc.record(1, "http://h/", b"hello", None)))


def test_cut_archives():
    data = archive([warc.record(1, "http://h/", b"hello" * 500, None)])
    for n in (4, 20, len(data) - 3):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_frames(data[:n]))


def test_through_spark(spark, tmp_path):
    big = "<p>same</p>" * 200
    rows = [(1, "http://a/", big), (2, "http://b/", big), (9, "http://c/", big), (3, None, None), (4, "u", ""), (5, "u", "\U0001f600" * 300), (6, "u", "small"), (7, "u", "small"), (9, "again", big)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "2 AS size", "3 AS salt")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = sorted((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.read_archives(spark, f"file://{tmp_path}/w").na.fill("").collect())
    assert len(got) == len(rows)
    for page_id, _, size, kind, refers, digest in got:
        html = next(h for i, _, h in rows if i == page_id) or ""
        assert size == len(html.encode()) and digest == hashlib.sha1(html.encode()).hexdigest()
        assert (kind, refers) == (("revisit", 9) if page_id in (1, 2) else ("response", None))


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0
