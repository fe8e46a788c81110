"""Toxicity by cumulative-link ordinal regression.

Features are the distinct lower-cased words of the whole text and their beginnings of three to five letters; those whose presence tells
toxic from other labelled texts best (log-odds over their standard error) are kept.  Labels are binary, so the severity of
a toxic example is graded by where its rate of telling features lies among the toxic examples (terciles): grades 0 (not
toxic) to 3.  One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - b_k), b_1 <= b_2 <= b_3, fitted by
gradient descent with momentum on a bounded sample (``TOXIC`` toxic and ``OTHER`` other labelled documents, chosen by a
hash of the id).  Every document gets its expected severity, sum over k of P(grade > k), its grade and a verdict.

*Defined cases.*  Null text, or text without a word: severity 0, grade 0, never toxic, whatever the labels.  Null labels or
ids: not learned from.  No labels, or labels of one kind only, tell nothing apart: severity 0 for all.  An id that several
rows of the documents share is learned from once, with the text that sorts first.  Very long texts are read whole.  Ties and
repeated rows: one result row per input row.  Extra columns are ignored, whatever their names.  An empty table gives an
empty table.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import tune

TOXIC, OTHER, FEATURES, MIN_DOCS, GRADES, STEMS, MIN_TELL = 1500, 3000, 1500, 4, 3, (3, 4, 5), 2.5
_WORD = re.compile(r"[^\W\d_]{2,}")


def features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*[{w[:n] + "*" for w in words if len(w) > n} for n in STEMS])


class Model:
    """Cumulative logits with shared weights over ordered thresholds."""

    def __init__(self, sample: list[tuple[str, int]]) -> None:
        toxic = np.array([y for _, y in sample], bool)
        self.weights, self.cuts = {}, np.zeros(GRADES)
        if not toxic.any() or toxic.all():
            self.cuts = np.full(GRADES, np.inf)
            return
        count: dict[str, list[int]] = {}
        for t, y in sample:
            for x in features(t):
                count.setdefault(x, [0, 0])[y > 0] += 1
        n = [int((~toxic).sum()), int(toxic.sum())]
        tell = {}
        for x, (a, b) in count.items():
            if a + b >= MIN_DOCS:
                odds = math.log((b + 0.5) / (n[1] - b + 0.5)) - math.log((a + 0.5) / (n[0] - a + 0.5))
                tell[x] = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        chosen = sorted(sorted((x for x in tell if abs(tell[x]) >= MIN_TELL), key=lambda x: (-abs(tell[x]), x))[:FEATURES])
        at = {x: k for k, x in enumerate(chosen)}
        strong = {x for x in chosen if tell[x] > 4}
        x, rate = np.zeros((len(sample), len(chosen)), np.float32), np.zeros(len(sample))
        for i, (t, _) in enumerate(sample):
            f = features(t)
            x[i, [at[w] for w in f if w in at]] = 1
            rate[i] = len(f & strong) / (1 + math.sqrt(len(f)))
        cut = np.quantile(rate[toxic], [k / GRADES for k in range(1, GRADES)])
        grade = np.where(toxic, 1 + (rate[:, None] > cut).sum(axis=1), 0)
        self._fit(x, grade, chosen)

    def _fit(self, x: np.ndarray, grade: np.ndarray, names: list[str], rounds: int = 400, rate: float = 0.05, ridge: float = 2e-4) -> None:
        above = (grade[:, None] > np.arange(GRADES)).astype(np.float32)
        w, first, step = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(GRADES - 1)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", w), ("f", np.zeros(1)), ("s", step))}
        for t in range(1, rounds + 1):
            cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(step))])  # ordered by construction
            p = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - cuts, -30, 30)))
            e = (p - above) / len(x)
            g_cut = -e.sum(axis=0)
            grads = {"w": x.T @ e.sum(axis=1).astype(np.float32) + ridge * w, "f": np.array([g_cut.sum()]), "s": np.array([g_cut[k + 1 :].sum() * math.exp(step[k]) for k in range(GRADES - 1)])}
            moved = {}
            for k, g in grads.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                moved[k] = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w = w - moved["w"].astype(np.float32)
            first -= float(moved["f"][0])
            step = step - moved["s"]
        self.cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(step))])
        self.weights = {k: float(v) for k, v in zip(names, w, strict=True) if abs(v) > 1e-4}

    def score(self, text: str | None) -> tuple[float, int, float]:
        """Expected severity, most likely grade, chance of being toxic at all."""
        own = features(text)
        if not own:
            return 0.0, 0, 0.0
        z = sum(map(self.weights.__getitem__, own.intersection(self.weights)))
        p = [1 / (1 + math.exp(max(-40.0, min(40.0, c - z)))) if c != math.inf else 0.0 for c in self.cuts.tolist()]
        chance = [a - b for a, b in zip([1.0, *p], [*p, 0.0], strict=True)]
        return sum(p), max(range(GRADES + 1), key=lambda k: (chance[k], -k)), p[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, other: int = OTHER) -> Model:
    """A model from a bounded sample of labelled rows.  Only the sample's ids meet the documents, so the join stays small."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_y"))
    by_hash = (F.xxhash64(F.lit("toxicity"), "_id"), "_id")
    picked = known.where("_y = 1").orderBy(*by_hash).limit(toxic).union(known.where("_y = 0").orderBy(*by_hash).limit(other)).groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("_text")).where(F.col("_text").isNotNull())
    # at most toxic + other rows come back: repeated ids meet in a partially aggregated minimum
    got = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_text"), F.max("_y")).collect()
    return Model([(r[1], r[2]) for r in sorted(got, key=lambda r: r[0])])


def severity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, severity, grade, p_toxic, toxic``, one row per document."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))

    def run(batches):
        for b in batches:
            got = [model.value.score(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array([p >= 0.5 for p in cols[2]], pa.bool_())], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
