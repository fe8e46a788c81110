"""SimHash near-duplicates through sharded BK-trees.

*Fingerprints.*  A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are three words joined by
spaces (fewer words: the whole sequence; no word or a null text: fingerprint zero).  A bit is set if more than half of the
shingles' XXH64 values (seed 42) have it.

*Links.*  Distinct fingerprints at most three bits apart are linked.  Any such pair agrees on at least ``b - 3`` of ``b``
equal blocks, so each choice of ``b - 3`` blocks deals the fingerprints out to shards by those blocks' bits and no pair is
lost.  Each shard grows one BK-tree (children keyed by integer Hamming distance to the parent) and every fingerprint of
the shard searches it, following only edges within the radius.  A single set of trees for the whole corpus would have to
pass through the driver and grow with the corpus, so trees are not broadcast: the queries are shipped to the shard's tree.
``b`` follows the number of fingerprints so that shards stay small.  A shard above ``SHARD_CAP`` is dealt out anew by its
remaining bits, twice if need be, after which at most 2^12 distinct values can be left: no cap drops anything.
A tree reports a spanning star of what it linked, not all pairs, so a group of n near copies costs n rows.

*Look-alikes* (``deduplicate`` only).  Edited copies of moderate length differ in more than three bits, so the pipeline adds
links between texts whose five-word shingles are similar to 0.8 or more.  Such texts meet in shards keyed by bands of a
one-permutation MinHash; each shard's BK-tree is searched within ``LOOK_RADIUS`` bits of the five-word fingerprints, and what
it finds is confirmed by the share of equal MinHash values (128, standard error 0.035, accepted from ``LOOK_LEAST``).  Each
group of linked texts in a shard has a tree of all its members; a text's search of a tree ends at the first member that
confirms it, so a group of n copies usually costs far fewer than n^2 comparisons and no pair of groups is left unlinked.

The rule is the same for a shard of any size: two texts are linked if they share a band, lie within the radius and have
enough equal values.  Texts of shards over ``SHARD_CAP`` (a passage that very many texts share) are dealt out anew by each of
``LOOK_BLOCKS`` runs of their MinHash values: two texts with enough equal values agree on all values of one run at least, and
that they share a band is then checked.  A shard that still holds more than ``LOOK_CAP`` texts is cut into chunks, and each pair
of chunks is a shard of its own, so no task holds more and no pair is dropped.  Two texts of similarity 0.8 share a band with
a chance of 99.7 %.

*Defined cases.*  Null or empty text: fingerprint zero, linked like any other.  Repeated rows and ties: each row is
returned, with the smallest non-null ``doc_id`` of its component (null if all are null).  ``deduplicate`` drops rows, not
ids: rows that share an id are told apart by their text, and of rows with equal id and text one stays, the one whose other
columns sort first.  Very long texts are read whole, their shingles in blocks.  Extra columns are ignored (``near_duplicates``)
or kept (``deduplicate``), whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep, partitions, sieve, temporary, tune
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Distinct fingerprints of one shard before it is dealt out anew, and the mean that the number of blocks aims at.
SHARD_CAP, SHARD_MEAN = 512, 64
#: Look-alikes: words of a shingle, MinHash values, bands of three of them, bits and share of equal values that confirm.
LOOK_SHINGLE, LOOK_VALUES, LOOK_BANDS, LOOK_RADIUS, LOOK_LEAST = 5, 128, 8, 20, 0.74
#: With so many runs of the MinHash values, one has no differing value if enough values are equal to confirm.
LOOK_BLOCKS = LOOK_VALUES - math.ceil(LOOK_LEAST * LOOK_VALUES) + 1
#: Texts of one shard that one task holds at most; more are cut into chunks that meet in pairs.
LOOK_CAP = 16_384
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 15


def _shingles(text: str | None, size: int):
    """Blocks of XXH64 values of the word shingles, repeats included; fewer words: the whole sequence."""
    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(width + 1) - 1
    start = end - width
    if len(words) < size:
        start, end = start[:1], end[-1:]
    else:
        start, end = start[: len(words) - size + 1], end[size - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(start), _BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(start[k : k + _BLOCK].tolist(), end[k : k + _BLOCK].tolist(), strict=True)], np.uint64)


def _majority(blocks) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big") if n else 0


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    return _majority(_shingles(text, SHINGLE))


def look(text: str | None) -> tuple[int, bytes, list[int]]:
    """``(five-word fingerprint, a byte of each MinHash value, a key of each band)``; no keys for a text without words."""
    blocks = list(_shingles(text, LOOK_SHINGLE))
    if not blocks:
        return 0, bytes(LOOK_VALUES), []
    h = np.concatenate(blocks)
    low = np.full(LOOK_VALUES, np.iinfo(np.uint64).max, np.uint64)
    place = (h >> np.uint64(57)).astype(np.int64)
    np.minimum.at(low, place, h & np.uint64((1 << 57) - 1))
    filled = np.unique(place)
    # an empty place takes the value of the next filled one, marked by how far away that is
    to = np.searchsorted(filled, np.arange(LOOK_VALUES))
    source = filled[to % len(filled)]
    gap = (source - np.arange(LOOK_VALUES)) % LOOK_VALUES
    with np.errstate(over="ignore"):
        value = (low[source] + gap.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95)
        value ^= value >> np.uint64(29)
        step = LOOK_VALUES // LOOK_BANDS
        at = np.arange(LOOK_BANDS) * step
        key = (value[at] * np.uint64(3) ^ value[at + step // 3] * np.uint64(0x9E3779B97F4A7C15) ^ value[at + 2 * step // 3]) * np.uint64(0xBF58476D1CE4E5B9)
    return _majority(blocks), (value >> np.uint64(40)).astype(np.uint8).tobytes(), key.view(np.int64).tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``, one row per input row; ``fp`` is the fingerprint as a signed long."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(fingerprint(t)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        """Insert a value that is not in the tree yet."""
        at, new = 0, len(self.values)
        self.values.append(value)
        self.edges.append({})
        while new:
            d = (value ^ self.values[at]).bit_count()
            if d not in self.edges[at]:
                self.edges[at][d] = new
                return
            at = self.edges[at][d]

    def within(self, value: int, radius: int = RADIUS) -> list[int]:
        """Positions of all values at most ``radius`` bits away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.edges[at]
            if edges:
                stack.extend(n for e, n in edges.items() if d - radius <= e <= d + radius)
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning stars of the links among distinct values: ``(value, smallest value it is connected with here)``."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def _masks(bits: list[int], blocks: int) -> list[int]:
    """Masks of every choice of ``blocks - RADIUS`` out of ``blocks`` near-equal runs of the given bit positions."""
    runs = [sum(1 << b for b in part.tolist()) for part in np.array_split(bits, blocks)]
    return [sum(c) for c in combinations(runs, blocks - RADIUS)]


def _left(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def _tree_links(batches):
    """Rows sorted by (mask, key): one BK-tree per shard; a shard may reach over batches."""
    at, values, out = None, [], []

    def ready(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        mask, key, fp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
            if hi <= lo:
                continue
            if at != (here := (int(mask[lo]), int(key[lo]))):
                if len(values) > 1:
                    out += shard_links(values)
                at, values = here, []
            values += [x & (1 << 64) - 1 for x in fp[lo:hi].tolist()]
        if len(out) > 10_000:
            yield ready([(_signed(x), _signed(y)) for x, y in out])
            out = []
    if len(values) > 1:
        out += shard_links(values)
    yield ready([(_signed(x), _signed(y)) for x, y in out])


def links(prints: DataFrame, shard_cap: int = SHARD_CAP) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> ``(a, b)`` links that span every set of fingerprints within the radius."""
    spark = prints.sparkSession
    n = prints.count()
    blocks = next(b for b in range(RADIUS + 1, 9) if b == 8 or n <= SHARD_MEAN << 64 * (b - RADIUS) // b)
    level = _masks(list(range(64)), blocks)
    rows = prints.select(F.explode(F.array(*[F.lit(_signed(m)) for m in level])).alias("mask"), "fp")
    cold = None
    for depth in range(3):
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        if depth == 2:
            part = rows
        else:
            sizes = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("size"))
            hot = keep(sizes.where(F.col("size") > shard_cap).drop("size"), "hot")
            part = rows if hot.isEmpty() else rows.join(hot, ["mask", "key"], "left_anti")
        cold = part if cold is None else cold.union(part)
        if depth == 2 or hot.isEmpty():
            break
        finer = {m: _masks(_left(m), 6) for m in level}
        level = sorted({m | c for m, cs in finer.items() for c in cs})
        # a fixed table: at most 35 x 20 and then 700 x 20 rows, whatever the corpus
        step = spark.createDataFrame([(_signed(m), [_signed(m | c) for c in cs]) for m, cs in finer.items()], "mask long, next array<long>")
        rows = rows.join(hot, ["mask", "key"]).join(F.broadcast(step), "mask").select(F.explode("next").alias("mask"), "fp").distinct()
    dealt = cold.repartition(partitions(spark), "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(_tree_links, "a long, b long")


def _grouped(prints: DataFrame, own: DataFrame, least) -> DataFrame:
    """``prints`` plus ``low``: the smallest ``least`` of all rows whose fingerprints the links ``own(distinct)`` connect."""
    with temporary(prints.sparkSession) as lasts:
        distinct = keep(prints.groupBy("fp").agg(F.min(least).alias("first")), "distinct")
        roots = components(own(distinct.select("fp"))).withColumnRenamed("node", "fp")
        rooted = keep(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
        low = keep(rooted.groupBy("root").agg(F.min("first").alias("low")), "low")
        of_print = lasts(keep(rooted.join(low, "root").select("fp", "low"), "of_print"))
    return prints.join(of_print, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_cap: int = SHARD_CAP, extra: DataFrame | None = None) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row: the smallest doc_id reachable over links within the radius,
    and over ``extra`` links ``(a, b)`` between fingerprints."""
    prints = keep(fingerprints(docs, id_col, text_col), "prints")
    own = lambda fps: links(fps, shard_cap) if extra is None else links(fps, shard_cap).union(extra)
    return _grouped(prints, own, F.col("doc_id")).select("doc_id", "fp", F.col("low").alias("component_id"))


def _confirmed(tree: BKTree, members: list, value: int, mine: np.ndarray, keys: frozenset) -> int | None:
    """The fingerprint of the first member within ``LOOK_RADIUS`` that shares a band and whose MinHash values confirm."""
    stack = [0]
    while stack:
        at = stack.pop()
        d = (value ^ tree.values[at]).bit_count()
        if d <= LOOK_RADIUS and not keys.isdisjoint(members[at][2]) and np.count_nonzero(members[at][1] == mine) >= LOOK_LEAST * LOOK_VALUES:
            return members[at][0]
        edges = tree.edges[at]
        if edges:
            stack.extend(n for e, n in edges.items() if d - LOOK_RADIUS <= e <= d + LOOK_RADIUS)
    return None


def _look_links(batches):
    """Rows sorted by shard: links that span the groups of texts which the shard's trees confirm."""
    at, held, out = None, [], []

    def search():
        if len({r[0] for r in held}) < 2:
            return
        groups: list[tuple[BKTree, list]] = []  # a tree and its members, in the same order
        same: dict[tuple, int] = {}
        for fp, fp5, sig, keys in held:
            if (first := same.setdefault((fp5, sig, keys), fp)) != fp:  # it links to just what the first one links to
                out.append((fp, first))
                continue
            value, mine = fp5 & (1 << 64) - 1, np.frombuffer(sig, np.uint8)
            linked = []
            for k, (tree, members) in enumerate(groups):
                other = _confirmed(tree, members, value, mine, keys)
                if other is not None:
                    linked.append(k)
                    if other != fp:
                        out.append((fp, other))
            if not linked:
                groups.append((BKTree(), []))
                linked = [len(groups) - 1]
            into = max(linked, key=lambda k: len(groups[k][1]))
            tree, members = groups[into]
            more = [(value, (fp, mine, keys))]
            for k in reversed(linked):
                if k != into:  # n members give fewer than n rows: each link but the first joins two groups
                    more += zip(groups[k][0].values, groups[k][1], strict=True)
            for v, m in more:
                tree.add(v)
                members.append(m)
            if len(linked) > 1:
                gone = set(linked) - {into}
                groups[:] = [g for k, g in enumerate(groups) if k not in gone]

    def ready():
        rows = [(a, b) for a, b in out]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        g = b.column(0).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        fp, fp5 = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi <= lo:
                continue
            if at != int(g[lo]):
                if len(held) > 1:
                    search()
                at, held = int(g[lo]), []
            held += [(int(fp[k]), int(fp5[k]), b.column(3)[k].as_py(), frozenset(b.column(4)[k].as_py())) for k in range(lo, hi)]
        if len(out) > 10_000:
            yield ready()
    if len(held) > 1:
        search()
    yield ready()


def looked(docs: DataFrame, row: Column | None = None, text_col: str = "text") -> DataFrame:
    """``(row, fp, fp5, sig, keys)``, one row per input row: both fingerprints, MinHash bytes and band keys, in one pass."""
    tune(docs.sparkSession)
    rows = docs.select((F.col("doc_id") if row is None else row).alias("row"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            got = [look(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(fingerprint(t)) for t in texts], pa.int64()), pa.array([_signed(x[0]) for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary()), pa.array([x[2] for x in got], pa.list_(pa.int64()))], ["row", "fp", "fp5", "sig", "keys"])

    return rows.mapInArrow(run, f"row {kind}, fp long, fp5 long, sig binary, keys array<long>")


def look_links(rows: DataFrame, shard_cap: int = SHARD_CAP, task_cap: int = LOOK_CAP) -> DataFrame:
    """Looked-at texts -> ``(a, b)`` links between three-word fingerprints of those that look alike."""
    spark = rows.sparkSession
    looks = keep(rows.where(F.size("keys") > 0).groupBy("fp", "fp5", "sig", "keys").agg(F.count(F.lit(1)).alias("n")).drop("n"), "looks")
    banded = looks.select("*", F.posexplode("keys").alias("band", "key")).withColumn("g", F.xxhash64("band", "key"))
    sizes = keep(banded.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "sizes")
    columns = ["g", "fp", "fp5", "sig", "keys"]
    several = banded.join(sizes, "g")  # only shards with company are dealt out
    dealt = several.where(F.col("size") <= shard_cap).select(columns)
    if not sizes.where(F.col("size") > shard_cap).isEmpty():
        hot = keep(several.where(F.col("size") > shard_cap).select(columns[1:]).distinct(), "hot-looks")
        runs = [(int(part[0]) + 1, len(part)) for part in np.array_split(np.arange(LOOK_VALUES), LOOK_BLOCKS)]
        finer = hot.select("*", F.posexplode(F.array(*[F.substring("sig", at, n) for at, n in runs])).alias("run", "part"))
        finer = finer.select(F.xxhash64(F.lit("run"), "run", "part").alias("g"), *columns[1:])
        sizes = keep(finer.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "run-sizes")
        finer = finer.join(sizes, "g")
        dealt = dealt.union(finer.where(F.col("size") <= task_cap).select(columns))
        # chunks of half a task's texts, by hash; chunk c meets every chunk, itself in the pairs with others
        chunks = F.ceil(F.col("size") * 2 / F.lit(task_cap)).cast("int") + 1
        mine = finer.where(F.col("size") > task_cap).withColumn("m", chunks).withColumn("c", F.pmod(F.xxhash64(F.lit("chunk"), "fp", "sig"), F.col("m")))
        mine = mine.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda x: x != F.col("c"))))
        dealt = dealt.union(mine.select(F.xxhash64(F.lit("pair"), "g", F.least("c", "other"), F.greatest("c", "other")).alias("g"), *columns[1:]))
    return dealt.repartition(partitions(spark), "g").sortWithinPartitions("g", "fp").mapInArrow(_look_links, "a long, b long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lookalikes: bool = True) -> DataFrame:
    """``docs`` with one row of each group of near copies left: the one with the smallest id (rows without one come last).

    A row is named by its id and an MD5 of its text; rows that share the name are exact copies, of which one stays."""
    text = F.unhex(F.md5(F.encode(F.col(text_col).cast("string"), "UTF-8")))
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("id"), text.isNull().alias("void"), F.coalesce(text, F.lit(b"")).alias("text"))
    with temporary(docs.sparkSession) as lasts:
        rows = keep(looked(docs, name, text_col), "looked")
        look = (lambda fps: links(fps).union(look_links(rows))) if lookalikes else links
        found = keep(_grouped(rows.select("row", "fp"), look, F.col("row")).select("row", "low"), "found")
        hashed = lambda df: df.select(F.xxhash64("row").alias("h"), "row")
        gone = lasts(keep(hashed(found.where("row != low").select("row").distinct()), "gone"))
        twice = lasts(keep(hashed(found.where("row = low").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")), "twice"))
    # only rows that the sieve takes for one of those to be looked up are joined; all others are not shuffled
    named = docs.select("*", name.alias("__sp_row")).withColumn("__sp_h", F.xxhash64("__sp_row"))
    named = sieve(gone.select("h").union(twice.select("h")))(named, "__sp_h")
    at = lambda few: (F.col("__sp_h") == few["h"]) & (F.col("__sp_row") == few["row"])
    sure = named.where(~F.col("__sp_pass")).select(*docs.columns)
    stay = named.where("__sp_pass").join(gone, at(gone), "left_anti")
    if twice.isEmpty():
        return sure.union(stay.select(*docs.columns))
    alone = sure.union(stay.join(twice, at(twice), "left_anti").select(*docs.columns))
    # copies under one name: all columns but the text, as one string, decide which stays; the minimum is partially aggregated
    rest = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != text_col]))
    one = stay.join(twice, at(twice), "left_semi").groupBy("__sp_h", "__sp_row").agg(F.min_by(F.struct(*docs.columns), rest).alias("one"))
    return alone.unionByName(one.select("one.*"))
