"""WARC archives with a two-level capture index.

*Archives.*  One WARC/1.1 record per page: ``response`` for the smallest page id of equal payloads, ``revisit`` (identical
payload digest) for the others.  Spark's own text writer writes the records, the blank lines between records being its line
separator, so archives go to any file system that Spark can write, and a lost or repeated task leaves no half archive.

*Index.*  The archives are read back record by record, payloads are hashed anew, and captures are sorted by reversed-host
URL key into blocks of ``BLOCK_LINES`` lines, gzip-compressed, one index file per range of keys.  A sparse directory has one
row per block.  A lookup finds the index file by its first key, binary-searches that file's part of the directory, reads
one block by its byte range, binary-searches its lines, and reads the record by its byte range.

*Defined cases.*  Null html: an empty payload.  Null url: key ``-``.  Rows that repeat page id and payload are all of the
same type.  Null page ids: revisits if a row with an id has the payload, else responses.  Extra columns are ignored.  An
empty table gives no records and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import keep, partitions, ranges, scratch, tune

DATE, MIN_REVISIT_BYTES, BLOCK_LINES, RECORDS_PER_FILE = "2024-01-01T00:00:00Z", 0, 256, 1000
BETWEEN, BLOCK_MAGIC, BLOCK_END = "\r\n\r\n", b"CDXBLK1\n", b"\n"
_BLOCK = "<8sIIII"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _line(value: str) -> str:
    """A header value must not break its line."""
    return "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in value)


def url_key(url: str | None) -> str:
    """Reversed-host key: ``https://a.example.com:443/x?y#z`` -> ``com,example,a)/x?y``; query and path keep their case."""
    if not url or not url.strip():
        return "-"
    url = _line(url.strip())
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    usual = {"http": 80, "https": 443}.get(parts.scheme.lower())
    shown = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != usual else "")
    return f"{shown}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first_url: str | None, revisit: bool, date: str = DATE) -> bytes:
    """One whole WARC record, less the two line ends after it."""
    name = uuid.uuid5(_NAMESPACE, f"{page_id}|{url}")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_NAMESPACE, f'{refers_to}|{first_url}')}>", f"WARC-Refers-To-Target-URI: {_line(first_url or '')}", f"X-Refers-To-Page: {refers_to}"]
    head += ["" if page_id is None else f"X-Page-Id: {page_id}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(x for x in head if x).encode() + b"\r\n\r\n" + block


def records(raw: bytes):
    """``(offset, length, headers, block)`` of every record of an archive; length without the line ends after it."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        if raw[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is cut off")
        yield at, stop - at, head, raw[end + 4 : stop]
        at = stop + 4


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> None:
    """Write archives.  Equal payloads meet by a partially aggregated minimum; only payloads that several pages have are
    joined back, by a broadcast below Spark's size threshold and else by an equi-join that AQE may split."""
    tune(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    first = rows.where(F.octet_length("body") >= min_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first"))
    shared = keep(first.where("n > 1").drop("n"), "shared")  # of known size, so that Spark need not shuffle pages where it is small
    dealt = rows.join(shared, "sha", "left").select("id", "url", "body", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"), (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))).alias("revisit"))

    def run(batches):
        for b in batches:
            out = [record(i, u, p, f, fu, r, date) for i, u, p, f, fu, r in zip(*[c.to_pylist() for c in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["raw"])

    made = dealt.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value"))
    made.write.option("lineSep", BETWEEN).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_CAPTURE = "url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
_FIELDS = [x.split()[0] for x in _CAPTURE.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives; payloads of responses are hashed anew and held against the record's own digest."""
    tune(spark)

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for at, size, head, block in records(raw.as_py()):
                    kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    n = int(head["x-payload-length"])
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if digest(payload) != said or len(payload) != n:
                            raise ValueError(f"{file}: the record at byte {at} is damaged")
                    page, to = head.get("x-page-id"), head.get("x-refers-to-page")
                    rows.append((url_key(head["warc-target-uri"]), int(page) if page else None, n, said, kind, int(to) if to else None, file, at, size))
                cols = list(zip(*rows, strict=True)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _FIELDS)

    return _files(spark, path).select("path", "content").mapInArrow(run, _CAPTURE)


def build_index(spark: SparkSession, archives: str, path: str) -> None:
    """Sort the captures by key into compressed blocks below ``path``; a key with very many captures may span files."""

    def run(batches):
        def block(lines):
            first, last = lines[0][0].encode(), lines[-1][0].encode()
            body = gzip.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode(), 6, mtime=0)
            return struct.pack(_BLOCK, BLOCK_MAGIC, len(lines), len(first), len(last), len(body)) + first + last + body

        held: list[list] = []
        for b in batches:
            held += map(list, zip(*[c.to_pylist() for c in b.columns], strict=True))
            out = []
            while len(held) >= BLOCK_LINES:
                out.append(block(held[:BLOCK_LINES]))
                held = held[BLOCK_LINES:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["raw"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(held)], pa.binary())], ["raw"])

    order = ["url_key", F.col("page_id").asc_nulls_last(), "file", "offset"]
    rows = keep(captures(spark, archives), "captures")  # read once: the range sort samples it first
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    lines = dealt.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value"))
    lines.write.option("lineSep", BLOCK_END.decode()).text(path)


def _blocks(raw: bytes):
    """``(offset, length, first key, last key, lines, body)`` of every block of an index file."""
    at = 0
    while at < len(raw):
        magic, n, a, z, size = struct.unpack_from(_BLOCK, raw, at)
        if magic != BLOCK_MAGIC:
            raise ValueError(f"no index block at byte {at}")
        k = at + struct.calcsize(_BLOCK)
        length = struct.calcsize(_BLOCK) + a + z + size
        yield at, length, raw[k : k + a].decode(), raw[k + a : k + a + z].decode(), n, raw[k + a + z : at + length]
        at += length + len(BLOCK_END)


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """All captures, read from the index's blocks."""
    tune(spark)

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                for *_, body in _blocks(raw.as_py()):
                    cols = list(zip(*[json.loads(x) for x in gzip.decompress(body).decode().split("\n")], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], _FIELDS)

    return _files(spark, path).select("content").mapInArrow(run, _CAPTURE)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The sparse directory: ``first_key, last_key, file, offset, length`` of every block."""

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(first, last, file, at, size) for at, size, first, last, _, _ in _blocks(raw.as_py())]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], ["first_key", "last_key", "file", "offset", "length"])

    return _files(spark, path).select("path", "content").mapInArrow(run, "first_key string, last_key string, file string, offset long, length long")


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """Bytes of a file on any file system that Spark knows."""
    with ranges(spark, file) as read:
        return read(offset, length)


class CaptureIndex:
    """Keyed access.  ``blocks`` is a kept directory; only the rows of the index files that can hold a key are fetched."""

    def __init__(self, blocks: DataFrame) -> None:
        self.spark, self.blocks, self.parts = blocks.sparkSession, blocks, {}
        self.files = sorted((r["lo"], r["hi"], r["file"]) for r in blocks.groupBy("file").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect())

    def find(self, url: str) -> list[dict]:
        """All captures of a URL."""
        key, out = url_key(url), []
        for lo, hi, file in self.files:
            if not lo <= key <= hi:
                continue
            if file not in self.parts:
                self.parts[file] = sorted((r["first_key"], r["last_key"], r["offset"], r["length"]) for r in self.blocks.where(F.col("file") == file).collect())
            part = self.parts[file]
            at = max(0, bisect_left([p[0] for p in part], key) - 1)
            while at < len(part) and part[at][0] <= key:
                (*_, body), = _blocks(read_range(self.spark, file, part[at][2], part[at][3]))
                lines = [json.loads(x) for x in gzip.decompress(body).decode().split("\n")]
                keys = [x[0] for x in lines]
                out += [dict(zip(_FIELDS, x, strict=True)) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
                at += 1
        return out

    def payload(self, capture: dict) -> bytes:
        """The payload of a response, read by its byte range."""
        (_, _, _, block), = records(read_range(self.spark, capture["file"], capture["offset"], capture["length"]) + b"\r\n\r\n")
        return block[block.index(b"\r\n\r\n") + 4 :]


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives and their index to shared scratch space; one row per capture, from the index."""
    spark = pages.sparkSession
    archives, index = scratch(spark, "warc"), scratch(spark, "cdx")
    write(pages, archives, **options)
    build_index(spark, archives, index)
    return indexed(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "offset", "length")
