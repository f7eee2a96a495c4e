import base64
import gzip
import hashlib

import pytest

from cuesheet.llm import warc
from cuesheet.llm.common import work_path


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_chunks_and_revisits(spark):
    big = bytes(range(256)) * 2000
    rows = [(1, "http://a/", b"abc"), (2, "http://b/\r\nX: y", b"abc"), (3, None, None), (4, "u", b""), (5, "u", big), (5, "u", big), (None, "u", b"abc"), (6, "u", b"\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "id long, uri string, payload binary").selectExpr("*", "'z' AS digest", "0 AS chunk_no")
    index = warc.write_warc(warc.with_revisits(df), work_path(spark, "t"), chunk_bytes=1000)
    got = warc.read_warc(index, chunk_bytes=1000).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["chunk_no"]):
        assert len(r["chunk"]) <= 1000
        by.setdefault((r["record_id"], r["record_type"], r["refers_to"]), []).append(r)
    assert by[("1", "revisit", "2")][-1]["digest"] == b32(b"abc") and by[("1", "revisit", "2")][-1]["payload_bytes"] == 3
    assert ("2", "response", None) in by and ("null", "response", None) in by and ("3", "revisit", "4") in by
    two = [r for r in got if r["record_id"] == "5"]
    assert len(two) == 2 * 512 and all(r["record_type"] == "response" for r in two)
    upto = [r["digest"] for r in sorted(two, key=lambda r: r["chunk_no"])][::2]
    assert upto[0] == b32(big[:1000]) and upto[-1] == b32(big)
    assert b"".join(bytes(r["chunk"]) for r in by[("6", "response", None)]) == b"\r\n\r\nWARC/1.1\r\n"


def test_files_are_warc(spark):
    df = spark.createDataFrame([(1, "http://a/", b"hello")], "id long, uri string, payload binary")
    index = warc.write_warc(warc.with_revisits(df), work_path(spark, "t")).collect()
    path = index[0]["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    text = gzip.decompress(raw[index[0]["offset"] : index[0]["offset"] + index[0]["length"]])
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\nhello\r\n\r\n")


def test_damage_is_found():
    stream = warc._Stream(__import__("io").BytesIO(gzip.compress(warc._header("1", "response", "", "A" * 32, 3, None) + b"abc\r\n\r\n")), 100)
    with pytest.raises(ValueError):
        list(warc._records(stream, 100))
    cut = warc._Stream(__import__("io").BytesIO(gzip.compress(warc._header("1", "response", "", b32(b"abc"), 3, None) + b"a")), 100)
    with pytest.raises(EOFError):
        list(warc._records(cut, 100))


def test_empty(spark):
    df = spark.createDataFrame([], "id long, uri string, payload binary")
    assert warc.read_warc(warc.write_warc(warc.with_revisits(df), work_path(spark, "t"))).count() == 0


def test_query(spark, sf):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = warc.query(spark, sf).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    assert all(r["payload_digest"] == b32(pages[r["page_id"]]) and r["payload_bytes"] == len(pages[r["page_id"]]) for r in got)
