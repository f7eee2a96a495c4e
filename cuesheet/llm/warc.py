"""WARC archives as a chunked record table.

``write_warc`` streams records into gzip-member WARC/1.1 files, one file per task, and returns the index (path, offset,
length, record id). ``read_warc`` turns files into rows (record_id, chunk_no, chunk, end_offset, digest so far): a
payload of any size passes in chunks of at most ``chunk_bytes``, each row carrying the running SHA-1, so neither reading
nor checking a record needs it whole. When writing, a record's payload is one value of the incoming row, which Spark
holds whole; from there on it is hashed and compressed in pieces, in batches bounded by rows and bytes. The last chunk's digest must equal the header's.

Files go to the shared folder under a name that no other task attempt uses; the index holds only those of successful
attempts and is itself written, so a lost executor costs a rewritten file and nothing else.

Of records with equal payloads of at least ``min_revisit`` bytes, the one with the largest id is the response and the
others are revisit records that name it and repeat its digest and size. The choice is one aggregation by digest and one
join back on it; a digest that holds a third of all rows is a skewed sort-merge join, which Spark splits.

Defined cases: a null payload is empty; a null id makes a record ``<urn:row:null>`` which is never the response of
others; rows that repeat the largest id are all responses; an empty table makes no files and an empty result; only the
named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, qualified, table, work_path

CHUNK = 1 << 20
INDEX = "path string, offset long, length long, record_id string"
ROWS = (
    "record_id string, record_type string, refers_to string, chunk_no int, chunk binary, end_offset long, "
    "payload_bytes long, digest string, last boolean"
)
_ROWS = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("chunk_no", pa.int32()), ("chunk", pa.binary()),
     ("end_offset", pa.int64()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("last", pa.bool_())]
)
_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a:") else uri)


def _pieces(data: memoryview, size: int) -> Iterator[memoryview]:
    for at in range(0, len(data), size):
        yield data[at : at + size]


def _b32(h) -> str:
    return base64.b32encode(h.digest()).decode()


def _header(record_id: str, kind: str, uri: str, digest: str, size: int, refers_to: str | None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:row:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if uri:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:row:{refers_to}>", f"X-Payload-Length: {size}",
        ]
    lines += ["Content-Type: text/html", f"Content-Length: {0 if kind == 'revisit' else size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _writer(folder: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        out, path, offset = None, f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            told: list[list] = [[], [], [], []]
            ids, uris, kinds, refers, payloads = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                found = payloads[i].as_buffer()
                data = memoryview(found) if found is not None else memoryview(b"")
                h = hashlib.sha1()
                for p in _pieces(data, chunk):
                    h.update(p)
                kind, record_id = kinds[i].as_py(), ids[i].as_py() or "null"
                z, start = zlib.compressobj(1, zlib.DEFLATED, 31), offset
                head = _header(record_id, kind, uris[i].as_py() or "", _b32(h), len(data), refers[i].as_py())
                offset += out.write(z.compress(head))
                for p in _pieces(data, chunk) if kind == "response" else ():
                    offset += out.write(z.compress(p))
                offset += out.write(z.compress(b"\r\n\r\n") + z.flush())
                for column, v in zip(told, (path, start, offset - start, record_id), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(told, _INDEX, strict=True)], schema=_INDEX)
        if out is not None:
            out.close()

    return run


class _Stream:
    """Bytes of a file of gzip members, taken out in bounded pieces."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk = raw, chunk
        self.z, self.waiting, self.ready = None, b"", b""

    def _fill(self) -> bool:
        while not self.ready:
            if not self.waiting:
                self.waiting = self.raw.read(self.chunk)
                if not self.waiting:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            self.ready = self.z.decompress(self.waiting, self.chunk)
            self.waiting = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
        return True

    def until(self, mark: bytes) -> bytes:
        """Up to and without mark; empty at the end of the file."""
        got = b""
        while (at := got.find(mark)) < 0:
            if not self._fill():
                return b""
            got, self.ready = got + self.ready, b""
        self.ready = got[at + len(mark) :]
        return got[:at]

    def upto(self, n: int) -> bytes:
        got = []
        while n and self._fill():
            piece, self.ready = self.ready[:n], self.ready[n:]
            got.append(piece)
            n -= len(piece)
        if n:
            raise EOFError("the archive ends inside a record")
        return b"".join(got)


def _id(value: str | None) -> str | None:
    return value[len("<urn:row:") : -1] if value else None


def _records(stream: _Stream, chunk: int) -> Iterator[tuple]:
    while head := stream.until(b"\r\n\r\n"):
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        kind, size = fields["WARC-Type"], int(fields["Content-Length"])
        whole = int(fields.get("X-Payload-Length", size))
        declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        about = (_id(fields["WARC-Record-ID"]), kind, _id(fields.get("WARC-Refers-To")))
        h, at, no = hashlib.sha1(), 0, 0
        while True:
            data = stream.upto(min(chunk, size - at))
            h.update(data)
            at += len(data)
            last = at == size
            running = declared if kind == "revisit" else _b32(h)
            if last and running != declared:
                raise ValueError(f"record {about[0]}: the payload doesn't have the digest of its header")
            yield (*about, no, data, at, whole, running, last)
            no += 1
            if last:
                break
        stream.upto(4)


def _reader(chunk: int, most: int = 4 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)

        for paths in batches:
            for uri in paths.column(0).to_pylist():
                system, path = _open(uri)
                with system.open_input_stream(path, compression=None) as raw:
                    for row in _records(_Stream(raw, chunk), chunk):
                        rows.append(row)
                        held += len(row[4])
                        if held >= most or len(rows) >= 1000:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()

    return run


def write_warc(records: DataFrame, folder: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """records(record_id string, uri, record_type, refers_to, payload binary) into files below folder; the index, which
    is written beside them. Runs at once."""
    spark = records.sparkSession
    full = qualified(spark, folder)
    scheme = full.split("://")[0] + "://" if "://" in full else ""
    bounded_batches(spark)
    shaped = records.select("record_id", "uri", "record_type", "refers_to", "payload")
    index = materialise(shaped.mapInArrow(_writer(full, chunk_bytes), INDEX), "warc-index")
    return index.withColumn("path", F.concat(F.lit(scheme if scheme == "file://" else full[: len(full) - len(_open(full)[1])]), "path"))


def read_warc(index: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """The chunk rows of all files in an index (column path)."""
    spark = index.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return index.select("path").distinct().repartition(parts).mapInArrow(_reader(chunk_bytes), ROWS)


def with_revisits(records: DataFrame, min_revisit: int = 0) -> DataFrame:
    """records(id long, uri, payload) -> record_id, uri, record_type, refers_to, payload."""
    keyed = records.select("id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    keyed = keyed.withColumns({"_sha": F.unhex(F.sha1("payload")), "_n": F.octet_length("payload")})
    shared = keyed.groupBy("_sha", "_n").agg(F.max("id").alias("_keeper"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    keepers = materialise(shared, "warc-keepers")  # written first: Spark can split a hot digest only in a join of two scans
    older = (F.col("_n") >= min_revisit) & F.coalesce(F.col("id") < F.col("_keeper"), F.lit(False))
    return keyed.join(keepers, ["_sha", "_n"], "left").select(
        F.col("id").cast("string").alias("record_id"), "uri",
        F.when(older, "revisit").otherwise("response").alias("record_type"),
        F.when(older, F.col("_keeper").cast("string")).alias("refers_to"), "payload",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("payload"))
    chunks = read_warc(write_warc(with_revisits(pages), work_path(spark, "warc")))
    return chunks.where("last").select(
        F.when(F.col("record_id") != "null", F.col("record_id").cast("long")).alias("page_id"),
        "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS keeper FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', h[i]) - 1), 4, '0')), '') AS b FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(b[5*j+1] AS INT) + 8 * CAST(b[5*j+2] AS INT) + 4 * CAST(b[5*j+3] AS INT) + 2 * CAST(b[5*j+4] AS INT) + CAST(b[5*j+5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM bits
"""
