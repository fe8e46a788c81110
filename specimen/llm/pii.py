"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give the person away.

*Base.*  ``email``, ``ip``, ``card`` and ``phone`` as documented at ``base_spans``.

*Sanitisation* (after Sanchez and Batet).  Protected entities are the distinct base values.  Terms that stand within
``WINDOW`` words of a mention co-occur with its entity.  Counts come from the whole corpus: a pair's support is its number
of distinct contexts (copies of one passage count once), a term's frequency its number of documents.  The disclosure of
entity e by term t is PMI(t, e) / IC(e) = 1 + log2 p(e|t) / IC(e): 1 where the term reveals the entity for certain.  Every
co-occurring pair is scored; p(e|t) is the lower end of its confidence interval (Wilson, one-sided 95 %), so little evidence
counts for less.  Pairs with a disclosure of ``GENERALISE`` or more become spans of kind ``term``: generalised to their class
of word, or removed from ``REMOVE`` on, wherever they stand in a text that mentions the entity.  Term frequencies are counted
in one pass over all texts, whatever the number of candidate terms: a Bloom filter of at most ``BLOOM_BITS`` bits spares the
counting of most other words, and a join drops the rest, so the filter changes no result.

*Defined cases.*  Null or empty text: no spans; sanitised text stays as it is.  Very long texts are read whole, in time in
proportion to their length, and a context is ``WINDOW`` whole words however long they are.  Offsets are code points, ends
exclusive.
Null ids, ties and repeated rows: one result row per input row.  Extra columns are ignored (``find``) or kept
(``sanitise``).  An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep, temporary, tune

KINDS = ["email", "ip", "card", "phone", "term"]
WINDOW, Z, GENERALISE, REMOVE = 8, 1.645, 0.8, 0.95
#: Bits of the filter that is sent to the executors (2 MB), and words that a Python worker remembers to be in it or not.
BLOOM_BITS, MEMO = 1 << 24, 500_000
_IS_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin at the start of a run of digits, and runs are taken whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]")
#: Every text with a base span has this, most others have not.
_MAY = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[ -]?[0-9]){15}|\+[0-9][ ().0-9-]"
_TERM = re.compile(r"[^\W\d_]+")


def _emails(text: str):
    """Leftmost addresses.  The local part reaches left from an @ as far as it can, so each @ is looked at once."""
    last = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _IS_LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)``, leftmost and non-overlapping per kind, ordered by kind, then start.

    ip: four numbers of at most 255; card: 16 to 19 digits that pass the Luhn test; phone: + and 8 to 15 digits."""
    if not text:
        return []
    out = [("email", a, z) for a, z in _emails(text)] if "@" in text else []
    if not _NUMBER.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:{re.sub('[^0-9]', '', value)}"


def _outside(text: str, spans: list[tuple[str, int, int]]):
    """Words that touch no base span, in order."""
    inside = sorted((s, e) for _, s, e in spans)
    k = last = 0
    for m in _TERM.finditer(text):
        while k < len(inside) and inside[k][0] < m.end():  # ``last`` is how far spans that begin before the word's end reach
            last, k = max(last, inside[k][1]), k + 1
        if last <= m.start():
            yield m


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Each mention's entity, a hash of its context, and the terms around it: ``WINDOW`` whole words on either side."""
    words = list(_outside(text, spans))
    start, out = [m.start() for m in words], []
    for kind, s, e in spans:
        near = [m[0].lower() for m in words[max(0, bisect_left(start, s) - WINDOW) : bisect_left(start, e) + WINDOW]]
        context = int.from_bytes(hashlib.blake2b(" ".join(near).encode(), digest_size=8).digest(), "big", signed=True)
        out.append({"entity": entity(kind, text[s:e]), "context": context, "terms": near})
    return out


_MENTIONS = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64()), ("terms", pa.list_(pa.string()))]))
_SCAN = "doc_id long, text_key string, n_email long, n_ip long, n_card long, n_phone long, base string, held string, mentions array<struct<entity:string,context:long,terms:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over whole texts.  ``text_key`` (null without a mention) names the text ``held``: equal texts have equal spans."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            key, counts, base, held, found = [], [], [], [], []
            for t in b.column(1).to_pylist():
                spans = base_spans(t)
                key.append(hashlib.md5(t.encode()).hexdigest() if spans else None)
                counts.append([sum(k == kind for k, _, _ in spans) for kind in KINDS[:4]])
                base.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
                held.append(t if spans else None)
                found.append(mentions(t, spans) if spans else [])
            n = list(zip(*counts, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.string()), *[pa.array(c, pa.int64()) for c in n], pa.array(base, pa.string()), pa.array(held, pa.string()), pa.array(found, _MENTIONS)], [x.split()[0] for x in _SCAN.split("array")[0].split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, _SCAN)


def bloom(terms: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of the distinct ``term`` values, three bits each; built in partial aggregates of at most bits / 64 rows."""
    h = F.xxhash64("term")
    at = [F.pmod(F.shiftrightunsigned(h, k), F.lit(bits)) for k in _SHIFTS]
    rows = terms.select(F.explode(F.array(*at)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    out = np.zeros(bits >> 6, np.int64)
    for r in rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        out[r["word"]] = r["mask"]
    return out.view(np.uint64)


_SHIFTS = (0, 20, 40)


class Wanted:
    """Which words the filter lets pass; a worker remembers what it has looked up."""

    def __init__(self, filter: np.ndarray) -> None:
        self.filter, self.known, self.passing = filter, set(), set()

    def __reduce__(self):
        return Wanted, (self.filter,)

    def of(self, words: set[str]) -> set[str]:
        new = words - self.known
        if new:
            if len(self.known) > MEMO:
                self.known, self.passing = set(), set()
                new = words
            self.known |= new
            bits = len(self.filter) << 6
            for w in new:
                h = xxhash.xxh64_intdigest(w.encode(), 42)  # what the JVM's xxhash64 gives
                if all(int(self.filter[(x := (h >> k) % bits) >> 6]) >> (x & 63) & 1 for k in _SHIFTS):
                    self.passing.add(w)
        return self.passing & words


def term_frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text", bits: int = BLOOM_BITS) -> DataFrame:
    """``(term, df)``: documents that have each of the given distinct terms, counted over all whole texts in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Wanted(bloom(terms, bits)))

    def run(batches):
        wanted = shared.value
        for b in batches:
            seen: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                for w in wanted.of(set(_TERM.findall((t or "").lower()))):
                    seen[w] = seen.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return terms.join(keep(counted, "df"), "term")


def _surely(k: Column, n: Column) -> Column:
    """The lower end of the confidence interval of a share ``k`` of ``n``."""
    p = k / n
    return (p + Z * Z / (2 * n) - Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def disclosures(texts: DataFrame, docs: DataFrame, text_col: str = "text", least: float = GENERALISE) -> DataFrame:
    """``(entity, term, disclosure)`` of the pairs over the threshold.  ``texts`` has the mentions of each distinct text."""
    rows = texts.select(F.inline("mentions"))
    contexts = rows.groupBy("entity", "context").agg(F.first("terms").alias("terms"))
    entities = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    pairs = contexts.select("entity", "context", F.explode(F.array_distinct("terms")).alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair"))
    n = docs.count()
    ic = -F.log2(F.least(F.lit(1.0), F.col("n_entity") / F.lit(max(n, 1)))) + F.lit(1e-12)
    # no pair is lost: its disclosure is highest if the term stands in no other document
    pairs = pairs.join(entities, "entity").where(1 + F.log2(_surely(F.col("n_pair"), F.col("n_pair"))) / ic >= least)
    pairs = keep(pairs, "pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    df = term_frequencies(docs, pairs.select("term").distinct(), text_col)
    p = _surely(F.least(F.col("n_pair"), F.col("df")), F.col("df"))
    scored = pairs.join(df, "term").select("entity", "term", (1 + F.log2(p) / ic).alias("disclosure"))
    return keep(scored.where(F.col("disclosure") >= least), "disclosures")


def occurrences(text: str, wanted: list[dict]) -> list[dict]:
    """``start, end, d`` of every place in the whole text where one of the terms stands outside base spans."""
    value = {w["term"]: w["d"] for w in wanted}
    return [{"start": m.start(), "end": m.end(), "d": value[w]} for m in _outside(text, base_spans(text)) if (w := m[0].lower()) in value]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("d", pa.float64())]))


def _term_spans(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``(text_key, terms)``: the spans of revealing terms of each distinct text, as ``array<struct<start,end,d>>``."""
    rows = texts.select("text_key", F.explode(F.array_distinct("mentions.entity")).alias("entity")).join(found, "entity")
    wanted = rows.groupBy("text_key", "term").agg(F.max("disclosure").alias("d")).groupBy("text_key").agg(F.collect_list(F.struct("term", "d")).alias("wanted"))

    def run(batches):
        for b in batches:
            spans = [occurrences(t, w) for t, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], ["text_key", "terms"])

    made = texts.join(wanted, "text_key").select("text_key", "held", "wanted").mapInArrow(run, "text_key string, terms array<struct<start:int,end:int,d:double>>")
    return made.where(F.size("terms") > 0)


def _detect(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    scanned = keep(scan(docs, id_col, text_col), "pii")
    with temporary(docs.sparkSession) as lasts:
        texts = scanned.where("text_key is not null").groupBy("text_key").agg(F.first("mentions").alias("mentions"), F.first("held").alias("held"))
        texts = keep(texts, "texts")
        terms = lasts(keep(_term_spans(texts, disclosures(texts, docs, text_col)), "terms"))
    return scanned, terms


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans, a digest of them, and all spans, base and revealing terms."""
    scanned, terms = _detect(docs, id_col, text_col)
    with_mentions = scanned.where("text_key is not null").drop("mentions", "held").join(terms, "text_key", "left")
    without = scanned.where("text_key is null").drop("mentions", "held").withColumn("terms", F.lit(None).cast(terms.schema["terms"].dataType))
    more = F.coalesce(F.array_join(F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"], x["end"])), ","), F.lit(""))
    spans = F.concat_ws(",", F.nullif(F.col("base"), F.lit("")), F.nullif(more, F.lit("")))
    return with_mentions.select(*without.columns).union(without).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def clean(text: str | None, terms: list[dict] | None) -> str | None:
    """A text with base spans replaced by their kind, and revealing terms generalised or removed."""
    spans = [(s, e, f"[{k.upper()}]") for k, s, e in base_spans(text)]
    for t in terms or []:
        word = text[t["start"] : t["end"]]
        spans.append((t["start"], t["end"], "" if t["d"] >= REMOVE else "[NAME]" if word[:1].isupper() else "[WORD]"))
    if not spans:
        return text
    out, at = [], 0
    for s, e, to in sorted(spans):
        if e <= at:
            continue  # within what the last span has covered
        out += [text[at : max(at, s)], to if s >= at else ""]
        at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts, same columns and rows.  Only texts that may have a base span can have revealing terms,
    so only they are joined; the others are not shuffled, however many terms there are."""
    _, terms = _detect(docs, id_col, text_col)
    cols = docs.columns
    none = F.lit(None).cast(terms.schema["terms"].dataType).alias("__sp_t")
    may = F.coalesce(F.col(text_col).cast("string").rlike(_MAY), F.lit(False))
    if terms.isEmpty():
        joined = docs.select("*", none)
    else:
        keyed = docs.where(may).withColumn("__sp_key", F.md5(F.encode(F.col(text_col), "UTF-8")))
        joined = keyed.join(terms.select(F.col("text_key").alias("__sp_key"), F.col("terms").alias("__sp_t")), "__sp_key", "left").select(*cols, "__sp_t").union(docs.where(~may).select("*", none))
    at, schema = cols.index(text_col), docs.schema

    def run(batches):
        for b in batches:
            text = [clean(t, x) for t, x in zip(b.column(at).to_pylist(), b.column(len(cols)).to_pylist(), strict=True)]
            arrays = [b.column(k) if k != at else pa.array(text, pa.string()) for k in range(len(cols))]
            yield pa.RecordBatch.from_arrays(arrays, cols)

    return joined.mapInArrow(run, schema)
