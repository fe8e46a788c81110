"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits.  Seeds are a test item's word 3-grams, all of them: a gram's number of
documents is no reason to leave it out, for the grams of an item that leaked often are as common as its leaks.  One pass
over all whole documents finds the seeds; where ``MIN_SEEDS`` of one item lie close together, the passage around them and
the item are aligned (match +2, mismatch -1, gap -1).  A passage whose score reaches ``SCORE`` of a perfect one is a leak, be
it copied or edited.  Common seeds bring up many passages that are none; ``bound`` spares their alignment where no alignment
can reach ``SCORE``, so it changes no result.  The benchmark is sent to the executors in blocks of about ``BLOCK`` words, dealt
by a hash; each block reads the documents anew, so nothing is left out however many items there are.  An item longer than
that is a block's only large one.

*Defined cases.*  Null or empty documents and items: no leak; an item of fewer than three words is sought by its whole word
sequence, through an index of its own.  Very long documents are read whole.  Null ids, ties and repeated rows: one row for each document row and item.  Extra columns are ignored (``find``)
or kept (``decontaminate``), whatever their names.  Empty tables give an empty result (``find``) or all documents (``decontaminate``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import tune

N, MIN_SEEDS, SCORE, BLOCK = 3, 2, 0.5, 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best local score of item ``a`` in passage ``b``, and the passage's part, end exclusive.

    Row by row; a gap along the row is a running maximum of scores freed from the cost of the way."""
    n = len(b)
    way = np.arange(n + 1) * GAP
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, where = 0, (0, 0)
    for x in a:
        diagonal = row[:-1] + np.where((b == x) & (x >= 0), MATCH, MISMATCH)
        up = row[1:] + GAP
        take = np.where(diagonal >= up, diagonal, up)
        from_ = np.where(diagonal >= up, start[:-1], start[1:])
        new = np.concatenate([[0], np.maximum(take, 0)])
        origin = np.concatenate([[0], np.where(take > 0, from_, np.arange(1, n + 1))])
        lead = new - way
        top = np.maximum.accumulate(lead)
        at = np.maximum.accumulate(np.where(lead == top, np.arange(n + 1), 0))
        row, start = top + way, np.where(top + way > new, origin[at], origin)
        k = int(row.argmax())
        if row[k] > best:
            best, where = int(row[k]), (int(start[k]), k)
    return best, *where


def bound(words: np.ndarray, b: np.ndarray) -> int:
    """No alignment of an item with these distinct words in passage ``b`` scores more: a passage word adds at most a match
    if the item has it, and takes at least a mismatch or a gap if not."""
    run = np.concatenate([[0], np.cumsum(np.where(np.isin(b, words), MATCH, max(MISMATCH, GAP)))])
    return int((run - np.minimum.accumulate(run)).max())


def _codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit value of each run of ``n`` word numbers.  Were two runs ever to share one, an alignment would tell them apart."""
    out = np.full(max(0, len(ids) - n + 1), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ ids[j : len(ids) - n + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Benchmark:
    """A block of test items: word numbers, and for each length of seed the sorted seeds with the items that have them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.words: list[np.ndarray] = []
        self.need: list[int] = []
        seeds: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], np.int64)
            if len(ids):
                codes = np.unique(_codes(ids, min(N, len(ids))))
                seeds.setdefault(min(N, len(ids)), []).append((codes, len(self.items)))
                self.need.append(min(MIN_SEEDS, len(codes)))
                self.items.append((k, ids))
                self.words.append(np.unique(ids))
        self.index = []  # per length: sorted seeds, where the items of each begin, items
        for n, own in sorted(seeds.items()):
            code = np.concatenate([c for c, _ in own])
            item = np.repeat([i for _, i in own], [len(c) for c, _ in own])
            order = np.argsort(code, kind="stable")
            known, first = np.unique(code[order], return_index=True)
            self.index.append((n, known, np.append(first, len(code)), item[order]))

    def ids(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, place, seed)`` of every seed in a document, by item, then place.  Items with too few hits are left out."""
        found = []
        for n, known, first, item in self.index:
            if len(ids) < n:
                continue
            run = np.ones(len(ids) - n + 1, bool)
            for j in range(n):
                run &= ids[j : len(ids) - n + 1 + j] >= 0
            place = np.flatnonzero(run)
            if not len(place):
                continue
            code = _codes(ids, n)[place]
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            same = known[at] == code
            place, at = place[same], at[same]
            count = first[at + 1] - first[at]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append((item[np.repeat(first[at], count) + step], np.repeat(place, count), np.repeat(code[same], count)))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        item, place, seed = (np.concatenate(x) for x in zip(*found, strict=True))
        enough = np.bincount(item, minlength=len(self.items)) >= np.array(self.need)
        item, place, seed = (x[enough[item]] for x in (item, place, seed))
        order = np.lexsort((place, item))
        return item[order], place[order], seed[order]

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int, int, int]]:
        """``(item, share of a perfect score, seeds, aligned words, first word, last word + 1)`` of each item that leaked."""
        ids = self.ids(text)
        item_of, place, seed = self.hits(ids)
        out = []
        cut = np.flatnonzero(np.diff(item_of)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(item_of)], strict=True):
            if lo == hi:
                continue
            k = int(item_of[lo])
            item = self.items[k][1]
            need, reach, best = self.need[k], 2 * len(item), None
            cluster: list[tuple[int, int]] = []
            for i, g in [*zip(place[lo:hi].tolist(), seed[lo:hi].tolist(), strict=True), (1 << 60, -1)]:
                if cluster and i - cluster[-1][0] > reach:
                    if len({x for _, x in cluster}) >= need:
                        a, z = max(0, cluster[0][0] - len(item)), cluster[-1][0] + N + len(item)
                        if bound(self.words[k], ids[a:z]) >= SCORE * MATCH * len(item):
                            score, s, e = align(item, ids[a:z])
                            share = score / (MATCH * len(item))
                            if best is None or share > best[1]:
                                best = (self.items[k][0], share, len({x for _, x in cluster}), e - s, a + s, a + e)
                    cluster = []
                cluster.append((i, g))
            if best and best[1] >= SCORE:
                out.append(best)
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, -x[1]))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int):
    """Blocks of about ``block`` words, dealt by a hash; the driver holds one block at a time."""
    own = benchmark.select(F.col(item_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    n = own.agg(F.sum(F.regexp_count("t", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    parts = max(1, -(-2 * n // block))  # by hash, so aim at half a block
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("k", "t"), F.lit(parts)) == part).collect()
        if rows or parts == 1:
            yield Benchmark([(r["k"], r["t"]) for r in rows])


def _prepared(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, block: int):
    """Benchmark blocks, broadcast."""
    spark = docs.sparkSession
    tune(spark)
    for made in _blocks(benchmark, item_col, item_text_col, block):
        yield spark.sparkContext.broadcast(made)


_LEAKS = "doc_id long, item_id long, score double, seeds int, aligned_words int, first_word int, last_word int"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, score`` and the aligned passage of every leak (word numbers, end exclusive)."""
    out = None
    for shared in _prepared(docs, benchmark, item_col, item_text_col, block):

        def run(batches, shared=shared):
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in shared.value.leaks(t)]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.float64()] + [pa.int32()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _LEAKS.split(", ")])

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _LEAKS)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows in which a benchmark item leaked, same columns.  No join: rows are judged where they are."""
    at = docs.columns.index(text_col)
    for shared in _prepared(docs, benchmark, item_col, item_text_col, block):

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not shared.value.leaks(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
