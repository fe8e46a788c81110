"""Token ids as binary shards with a minimal perfect hash index.

Shard files hold raw little-endian ids of whole documents in ascending key order, each ended by the end id, and an index:
a minimal perfect hash (hash and displace) over the shard's keys maps a key to its document's offset in constant time; a
stored 32-bit fingerprint turns away keys that are not there.  A key's shard is found by binary search in the directory of
first and last keys.  Spark's own committer writes the files (one row, one file), to any file system that Spark can write,
so a task that is lost or runs twice leaves no half shard.

``lookup`` reads by byte range: a header, one displacement, one slot, and, where the stored fingerprint is the key's, the key,
two offsets and the ids themselves; what it reads does not grow with the shard.

Layout, little-endian: magic, u64 shard, u32 id bytes, u64 documents, u64 documents without a key, u64 hash slots, u64
buckets; i64 key[documents]; u64 offset[documents + 1] in ids; i32 displacement[buckets]; u32 document[slots]; u32
fingerprint[slots]; ids; end mark.

*Defined cases.*  Null or empty text: the end id alone.  Rows without a key come first, are stored and read back, and
cannot be looked up.  Repeated keys lie side by side; a lookup finds the first.  Very long texts are encoded whole and may make
a shard longer than ``SHARD_BYTES``.  An empty table gives no shards and an empty result.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import keep, partitions, ranges, scratch, tune
from .encode import default_path, encoder, gathered

END_ID, MAGIC, END_MARK = 2, b"SPTOKEN2", b"\nSPTOKEN-END\n"
#: Bytes of ids after which a shard is closed (at a document's end): a task holds one shard at a time.
SHARD_BYTES = 64 << 20
#: A shard's number is its range partition and, in the low ``SEQ_BITS`` bits, its place there.
SEQ_BITS = 32
_HEAD = struct.Struct("<8sQIQQQQ")
_ALL, _TURN, _SPIN = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 finaliser, vectorised."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: a displacement per bucket; buckets of one key name their slot."""

    def __init__(self, displacement: np.ndarray, slots: int) -> None:
        self.displacement, self.slots = displacement, slots

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        n = len(keys)
        if not n:
            return cls(np.zeros(0, np.int32), 0)
        m = n // 2 + 1
        bucket = (mix(keys, 0) % np.uint64(m)).astype(np.int64)
        base = mix(keys, 1)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=m)
        first = np.concatenate([[0], np.cumsum(size)])
        base = base[order].tolist()
        taken, shift = bytearray(n), np.zeros(m, np.int32)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            own = range(first[b], first[b + 1])
            d = 0
            while True:
                turn = d * _TURN & _ALL
                at = [(((base[k] ^ turn) * _SPIN & _ALL) >> 32) % n for k in own]
                if len(set(at)) == len(at) and not any(taken[x] for x in at):
                    break
                d += 1
                if d > 1 << 22:
                    raise ValueError("no displacement found; are the keys distinct?")
            for x in at:
                taken[x] = 1
            shift[b] = d
        free = [k for k in range(n) if not taken[k]]
        for b, x in zip(np.flatnonzero(size == 1).tolist(), free, strict=True):
            shift[b] = -x - 1
        return cls(shift, n)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return self.hop(keys, self.displacement[(mix(keys, 0) % np.uint64(len(self.displacement))).astype(np.int64)], self.slots)

    @staticmethod
    def hop(keys: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
        """Slots of keys whose buckets have these displacements."""
        d = displacement.astype(np.int64)
        with np.errstate(over="ignore"):
            turn = np.maximum(d, 0).astype(np.uint64) * np.uint64(_TURN)
            hop = ((((mix(keys, 1) ^ turn) * np.uint64(_SPIN)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        return np.where(d < 0, -d - 1, hop)


def _fp(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 3) & np.uint64(0xFFFFFFFF)).astype("<u4")


def build_shard(number: int, keys: list[int | None], payloads: list[bytes], width: int) -> bytes:
    """One shard file of documents in key order (those without a key first), less the end mark that the writer adds."""
    nulls = sum(k is None for k in keys)
    key = np.array([0 if k is None else k for k in keys], "<i8")
    offset = np.concatenate([[0], np.cumsum([len(p) // width for p in payloads])]).astype("<u8")
    known, first = np.unique(key[nulls:], return_index=True)
    known = known.astype(np.int64).view(np.uint64)
    index = PerfectHash.build(known)
    document, mark = np.zeros(index.slots, "<u4"), np.zeros(index.slots, "<u4")
    if index.slots:
        at = index.slot(known)
        document[at], mark[at] = first + nulls, _fp(known)
    head = _HEAD.pack(MAGIC, number, width, len(keys), nulls, index.slots, len(index.displacement))
    return b"".join([head, key.tobytes(), offset.tobytes(), index.displacement.astype("<i4").tobytes(), document.tobytes(), mark.tobytes(), *payloads])


class Shard:
    """A shard file that was read back."""

    def __init__(self, raw: bytes) -> None:
        magic, self.number, self.width, n, self.nulls, slots, buckets = _HEAD.unpack_from(raw)
        if magic != MAGIC or not raw.endswith(END_MARK):
            raise ValueError("not a whole token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.offset = take("<i8", n), take("<u8", n + 1).astype(np.int64)
        self.index = PerfectHash(take("<i4", buckets), slots)
        self.document, self.mark = take("<u4", slots), take("<u4", slots)
        self.ids = take("<u2" if self.width == 2 else "<u4", int(self.offset[-1]))
        if at + len(END_MARK) != len(raw):
            raise ValueError("token shard has a wrong length")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Document numbers of keys, -1 where the fingerprint or the key differs."""
        if not self.index.slots or not len(keys):
            return np.full(len(keys), -1)
        k = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.index.slot(k)
        doc = self.document[slot].astype(np.int64)
        return np.where((self.mark[slot] == _fp(k)) & (self.keys[doc] == keys), doc, -1)

    def ids_of(self, key: int) -> np.ndarray | None:
        doc = int(self.find(np.array([key], np.int64))[0])
        return None if doc < 0 else self.ids[self.offset[doc] : self.offset[doc + 1]]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, mode: str = "lead", end_id: int = END_ID, width: int = 2, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode whole texts and write shards below ``path``.  ``width``: bytes of an id (2 suffices below 65,536 ids).

    One range shuffle puts documents in key order (ties are split by their place in the input, so a key with very many
    rows does not land in one task); ids are made, indexed and written in the same stage, a shard at a time."""
    spark = docs.sparkSession
    tune(spark)
    file, kind = tokenizer or default_path("byte_bpe_50k.json"), f"<u{width}"

    def run(batches):
        from pyspark import TaskContext

        enc, end, part, seq = encoder(file, mode, kind), np.array([end_id], kind).tobytes(), TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0

        def shard():
            if seq >> SEQ_BITS:
                raise ValueError("too many shards in one range partition")
            return pa.RecordBatch.from_arrays([pa.array([build_shard(part << SEQ_BITS | seq, keys, held, width)], pa.binary())], ["raw"])

        for ids, texts in gathered(batches):
            for k, raw in zip(ids, enc.encode(texts), strict=True):
                keys.append(k)
                held.append(raw + end)
                size += len(raw)
                if size >= shard_bytes:
                    yield shard()
                    keys, held, size, seq = [], [], 0, seq + 1
        if keys:
            yield shard()

    # ties go by their place in the input, so that the sampling pass of the range shuffle reads the keys alone
    order = [F.col("k").asc_nulls_first(), "at"]
    cols = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"), F.monotonically_increasing_id().alias("at"))
    dealt = cols.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(run, "raw binary").select(F.col("raw").cast("string").alias("value"))
    rows.write.option("lineSep", END_MARK.decode()).option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document, found through the index: ``shard, doc, doc_id, local_start, n_tokens, ids_crc32``."""
    tune(spark)

    def run(batches):
        names = ["shard", "doc", "doc_id", "local_start", "n_tokens", "ids_crc32"]
        for b in batches:
            for raw in b.column(0):
                s = Shard(raw.as_py())
                n = len(s.keys)
                found = s.find(s.keys[s.nulls :])
                first = np.searchsorted(s.keys[s.nulls :], s.keys[s.nulls :]) + s.nulls
                if not np.array_equal(found, first):
                    raise ValueError(f"shard {s.number}: the index does not lead to every key")
                doc = np.arange(n)  # a repeated key's run begins where its lookup leads
                ids = s.ids.astype("<u4")
                start, end = s.offset[:-1], s.offset[1:]
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(start.tolist(), end.tolist(), strict=True)]
                key = pa.array(s.keys, pa.int64(), mask=doc < s.nulls)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s.number, np.int64)), pa.array(doc, pa.int64()), key, pa.array(start), pa.array(end - start), pa.array(crc, pa.int64())], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(run, "shard long, doc long, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write shards to shared scratch space, read them back: ``doc_id, start, n_tokens, ids_crc32``.

    Starts are running totals in two steps: of shards within each range partition, which run in parallel, and of range
    partitions, of which there are as many as the session has shuffle partitions."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write(docs, path, **options)
    rows = keep(read(spark, path), "read-back")
    total = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.shiftright("shard", SEQ_BITS))
    of_part = total.groupBy("part").agg(F.sum("n").alias("n"))
    before = of_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = total.select("part", "shard", (F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("within"))
    base = within.join(before, "part").select("shard", (F.col("before") + F.col("within")).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """``(file, shard, lo, hi)``: the first and last key of each shard that has keys."""

    def run(batches):
        for b in batches:
            rows = []
            for file, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard(raw.as_py())
                if s.nulls < len(s.keys):
                    rows.append((file, s.number, int(s.keys[s.nulls]), int(s.keys[-1])))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)], ["file", "shard", "lo", "hi"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, shard long, lo long, hi long")


def fetch(read, key: int) -> np.ndarray | None:
    """The ids of a key's document from a shard file, of which ``read(offset, length)`` gives bytes; None if it is not there."""
    magic, _, width, n, _, slots, buckets = _HEAD.unpack(read(0, _HEAD.size))
    if magic != MAGIC:
        raise ValueError("not a token shard")
    if not slots:
        return None
    number = lambda kind, at: np.frombuffer(read(at, np.dtype(kind).itemsize), kind)[0]
    keys, offsets = _HEAD.size, _HEAD.size + 8 * n
    shift, ids = offsets + 8 * (n + 1), offsets + 8 * (n + 1) + 4 * buckets + 8 * slots
    k = np.array([key], np.int64).view(np.uint64)
    bucket = int(mix(k, 0)[0] % np.uint64(buckets))
    slot = PerfectHash.hop(k, np.array([number("<i4", shift + 4 * bucket)]), slots)[0]
    if number("<u4", shift + 4 * buckets + 4 * slots + 4 * int(slot)) != _fp(k)[0]:
        return None  # the fingerprint turns a stranger away without a look at the keys
    doc = int(number("<u4", shift + 4 * buckets + 4 * int(slot)))
    if number("<i8", keys + 8 * doc) != key:
        return None
    start, end = np.frombuffer(read(offsets + 8 * doc, 16), "<u8").tolist()
    return np.frombuffer(read(ids + width * start, width * (end - start)), f"<u{width}")


def lookup(spark: SparkSession, shards: DataFrame, keys: list[int]) -> dict[int, list[int]]:
    """Ids of a few keys, by byte ranges.  ``shards``: a kept directory; only files whose keys reach over one asked for are opened."""
    wanted = spark.createDataFrame([(k,) for k in keys], "k long")
    near = shards.join(F.broadcast(wanted), F.col("k").between(F.col("lo"), F.col("hi"))).groupBy("file", "shard").agg(F.collect_list("k").alias("keys"))
    out: dict[int, list[int]] = {}
    for row in near.orderBy("shard").toLocalIterator() if keys else []:
        with ranges(spark, row["file"]) as read:
            for k in row["keys"]:
                if k not in out and (ids := fetch(read, k)) is not None:
                    out[k] = ids.tolist()
    return out
