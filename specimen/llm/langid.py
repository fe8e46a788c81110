"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte trigrams of the lower-cased whole text, as shares of all its trigrams.  The family is decided by
one-versus-rest linear SVMs; within a family each pair of languages has a linear SVM and the most pairs won decides.  All
are trained here with averaged stochastic subgradient steps (Pegasos, Shalev-Shwartz et al., 2007) on a bounded sample of
about ``SAMPLE`` labelled documents of each language, chosen by a hash of the id; every document is predicted.

*Defined cases.*  Null text, or text without a letter (Unicode category L): ``und`` with score 0.  Very long texts are read
whole, their trigrams in blocks.  Null language: never learned from.  Null id:
counts as held out.  Nothing to learn from: ``und`` everywhere.  Ties and repeated rows: one result row per input row.
Extra columns are ignored, whatever their names.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import tune

SAMPLE, MAX_BITS, MIN_BITS, SCALE, EPOCHS, LAMBDA = 600, 16, 10, 60.0, 12, 1e-4
#: Bytes of all weights, which are broadcast: more classifiers share fewer features each.
MODEL_BYTES = 64 << 20
#: A letter is a character of Unicode category L; number signs such as a half or a Roman eight are none.
_LETTER = regex.compile(r"\p{L}")
#: Languages (ISO 639-1) of some families; a language outside them is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af yi lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi ur bn mr gu pa ne",
    "semitic": "ar he am mt",
}


def family(lang: str) -> str:
    code = re.split("[-_]", lang.lower())[0]
    return next((k for k, v in FAMILIES.items() if code in v.split()), f"={lang}")


def trigrams(text: str, bits: int = MAX_BITS) -> np.ndarray:
    """Feature numbers of all byte trigrams; digits and marks below 128 count as a space."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    raw = _TABLE[raw].astype(np.uint32)
    code = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - bits)


_TABLE = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def train(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, bits: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """Averaged Pegasos on sparse rows ``(features, values)``; both signs weigh the same."""
    rng = np.random.default_rng(seed)
    w, mean, bias, mean_bias, steps = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0, 0
    share = {s: len(sign) / (2 * max(1, (sign == s).sum())) for s in (-1, 1)}
    scale = 1.0  # w is kept as scale * w, so that shrinking costs nothing
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            steps += 1
            rate = 1 / (LAMBDA * (steps + 1000))
            at, x = rows[i]
            y = sign[i]
            margin = y * (scale * (w[at] @ x) + bias)
            scale *= 1 - rate * LAMBDA
            if margin < 1:
                w[at] += rate * y * share[y] * x / scale
                bias += 0.01 * y * share[y]
        if epoch >= EPOCHS // 2:
            mean += scale * w
            mean_bias += bias
    n = EPOCHS - EPOCHS // 2
    return (mean / n).astype(np.float32), mean_bias / n


class Model:
    def __init__(self, sample: list[tuple[str, str]]) -> None:
        """``sample``: texts with their languages."""
        sample = [(t, x) for t, x in sample if t and _LETTER.search(t)]
        lang = [x for _, x in sample]
        self.families = {f: sorted({x for x in lang if family(x) == f}) for f in sorted({family(x) for x in lang})}
        machines = len(self.families) + sum(len(m) * (len(m) - 1) // 2 for m in self.families.values())
        self.bits = max(MIN_BITS, min(MAX_BITS, int(math.log2(MODEL_BYTES / (4 * max(1, machines))))))
        rows = []
        for text, _ in sample:
            at, n = np.unique(trigrams(text, self.bits), return_counts=True)
            rows.append((at, SCALE * n / n.sum()))
        langs, fam = np.array(lang, object), np.array([family(x) for x in lang], object)
        stack = lambda made: (np.ascontiguousarray(np.array([w for w, _ in made], np.float32).T), np.array([b for _, b in made]))
        self.family_m = stack([train(rows, np.where(fam == f, 1, -1), self.bits) for f in self.families]) if len(self.families) > 1 else None
        self.pairs, self.pair_m = {}, {}
        for f, members in self.families.items():
            made = []
            self.pairs[f] = list(combinations(range(len(members)), 2))
            for a, b in self.pairs[f]:
                own = [i for i in range(len(rows)) if langs[i] in (members[a], members[b])]
                made.append(train([rows[i] for i in own], np.where(langs[own] == members[a], 1, -1), self.bits))
            if made:
                self.pair_m[f] = stack(made)

    @staticmethod
    def _margins(machines: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        matrix, bias = machines
        total = np.zeros(matrix.shape[1])
        for k in range(0, len(at), 1 << 16):
            total += matrix[at[k : k + (1 << 16)]].sum(axis=0)
        return SCALE * total / len(at) + bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not _LETTER.search(text):
            return "und", 0.0
        at = trigrams(text, self.bits)
        names = list(self.families)
        sure, best = 1.0, names[0]
        if self.family_m is not None:
            m = self._margins(self.family_m, at)
            order = np.argsort(-m)
            best, sure = names[order[0]], _squash(m[order[0]] - m[order[1]])
        members = self.families[best]
        if len(members) == 1:
            return members[0], sure
        m = self._margins(self.pair_m[best], at)
        won, chance = np.zeros(len(members)), np.zeros(len(members))
        for (a, b), v in zip(self.pairs[best], m, strict=True):
            p = _squash(2 * v)
            won[a if p >= 0.5 else b] += 1
            chance[a] += p
            chance[b] += 1 - p
        k = max(range(len(members)), key=lambda i: (won[i], chance[i], -i))
        return members[k], float(sure * chance[k] / (len(members) - 1))


def _squash(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, float(x)))))


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learned from: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents of each language that are not held out."""
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    size = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}
    if not size:
        return Model([])
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in size.items() for x in (k, min(1.0, sample / n))]), F.col(lang_col))
    chance = F.pmod(F.xxhash64(F.lit("langid"), id_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    got = known.where(chance < share).select(text_col, lang_col, F.xxhash64(id_col).alias("h")).collect()
    return Model([(r[0], r[1]) for r in sorted(got, key=lambda r: (r[2], r[0]))])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per document.  Only the text enters a prediction."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col, sample))

    def run(batches):
        for b in batches:
            got = [model.value.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
