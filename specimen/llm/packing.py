"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``CAPACITY`` tokens (only longer documents are cut).  Pieces are dealt out to parts of
about ``PART_ROWS`` at random; each part is packed by best-fit decreasing and holds its bin count against a lower bound
from dual feasible functions: the plain sum, the threshold functions u_k(x) = (C if x > C - k, 0 if x < k, else x) for all
k, and the Fekete-Schepers functions.  Where both agree the part is certified optimal and settled.  Parts with a gap settle
their exactly full bins and exchange the documents of all others: these are dealt out anew, to fewer parts, and packed
again, for ``ROUNDS`` rounds at most.  A part is bounded in rows at any size of the corpus.

The certificate is part of the result: ``gap`` is the number of bins of the piece's part above its lower bound, when the bin
was settled; 0 means that the part is proved optimal, and a bin that is exactly full wastes nothing whatever its part's gap
(``full``).  ``certificate`` holds the corpus as a whole against its own lower bound.

*Defined cases.*  Null or empty text: one piece that holds the end id.  Null ids, ties and repeated rows: every row is
packed.  Very long texts are cut into pieces, never shortened.  Extra columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep, tune
from .encode import default_path, encoder, gathered

CAPACITY, END_ID, PART_ROWS, ROUNDS = 4096, 1, 16384, 4
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, uid long, part long, bin long, offset long, settled boolean, gap long, full boolean"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, mode: str = "drop", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each whole document."""
    tune(docs.sparkSession)
    path = tokenizer or default_path("word_bpe_49k.json")

    def run(batches):
        enc, end = encoder(path, mode), np.array([end_id], "<u4").tobytes()
        for ids, texts in gathered(batches):
            rows = []
            for d, raw in zip(ids, enc.encode(texts), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _PIECES)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bin count that any of the dual feasible functions proves necessary."""
    return lower_bound_of(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def lower_bound_of(n: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same from the number of pieces of each length."""
    if not n.any():
        return 0
    x = np.arange(capacity + 1)
    upto, sums = np.cumsum(n), np.cumsum(n * x)
    k = np.arange(0, capacity // 2 + 1)
    below = np.where(k > 0, sums[k - 1], 0)
    middle = sums[capacity - k] - below
    large = upto[-1] - upto[capacity - k]
    best = int(np.max(-(-(middle + large * capacity) // capacity)))
    for j in range(1, 31):
        scaled = (j + 1) * x
        exact = scaled % capacity == 0
        # numerators over capacity * j: x is kept where (j+1)x/C is whole, else floor((j+1)x/C)/j
        num = np.where(exact, x * j, scaled // capacity * capacity)
        best = max(best, int(-(-int((n * num).sum()) // (capacity * j))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """``(bin, offset, bins)``.  Open bins are found by residual: a bit per residual that some bin has."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = bins = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = mask >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                mask &= ~(1 << left)
        else:
            left, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - left
        if left > size:
            open_bins[left - size].append(b)
            mask |= 1 << left - size
    return where, offset, bins


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, and the certificate: the ``gap`` of their part, and whether their bin is ``full``."""
    at = keep(rows.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    done, columns = None, [x.split()[0] for x in _PACKED.split(", ")]
    for turn in range(rounds):
        n = at.count()
        if not n and turn:
            break
        last = turn == rounds - 1 or n <= part_rows
        parts = max(1, -(-n // part_rows))

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            sizes = pdf["length"].to_numpy(np.int64)
            where, offset, bins = best_fit_decreasing(sizes, capacity)
            gap = bins - lower_bound(sizes, capacity)
            full = np.bincount(where, sizes, minlength=bins)[where] == capacity
            return pdf.assign(bin=where, offset=offset, settled=full | (gap == 0) | last, gap=gap, full=full)[columns]

        dealt = at.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        packed = keep(dealt.groupBy("part").applyInPandas(fit, _PACKED), "packed")
        named = packed.where("settled").withColumn("sequence_id", F.lit(turn << 56) + F.col("part") * (1 << 24) + F.col("bin"))
        named = named.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap", "full")
        done = named if done is None else done.union(named)
        at = packed.where("not settled").select("doc_id", "piece", "start", "length", "ids_crc32", "uid")
    return done


def corpus_lower_bound(rows: DataFrame, capacity: int = CAPACITY) -> int:
    """The bound for the corpus as a whole, from its histogram of piece lengths (at most ``capacity`` rows)."""
    n = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count(F.lit(1))).collect():
        n[r[0]] = r[1]
    return lower_bound_of(n, capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """``(sequences, lower bound)`` of a packed corpus: the first can be at most their difference above the best there is."""
    return packed.select("sequence_id").distinct().count(), corpus_lower_bound(packed, capacity)
