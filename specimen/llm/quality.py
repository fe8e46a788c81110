"""Quality rules with adaptive thresholds: mergeable quantile sketches per language and source, then a joined filter.

Everything is DataFrame expressions.  One scan measures each whole text; the sketches are logarithmic-bucket histograms
(DDSketch, Masson et al., 2019): bucket counts add up, so they merge by a partially aggregated count at any level, do not
depend on the order of merging and have a relative error of 1 %.  The sketches of (language, source) merge into those of
the language and of the corpus.  A group's fence is drawn towards its language's by ``PRIOR`` documents, and the language's
towards the corpus's: with n documents its own fence weighs n / (n + PRIOR), so no group changes its fence at a stroke.

A document is rejected if a measure lies above its group's fence, each ``max(slack, q50 + REACH * (q75 - q50))``, or if the
fixed base rule rejects it (fewer than 50 words, or more than half of its words in repeated 3-word windows).  The slack
keeps groups whose quantiles are all zero from rejecting ordinary documents.

*Defined cases.*  Null text: no words, so rejected.  Null language or source: a group of its own.  Rows are independent,
so ties and repeated rows each get the same verdict.  Extra columns are ignored (``measure``) or kept (``apply_rules``).
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Sketch accuracy, documents by which a parent's fence weighs, and how far above the quartile the fence stands.
ACCURACY, PRIOR, REACH = 0.01, 50, 8.0
#: Measures and the slack of each: no fence lies below it.
SLACK = {"symbols_per_char": 0.06, "dup_lines_share": 0.5, "repeat_share": 0.4, "bangs_per_word": 0.3, "bars_per_word": 0.2}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body's lambdas use it for each element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that the text has at least twice.  Windows are compared by chained XXH64."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("n"))
        grow = lambda acc, p: F.struct((p + 2).alias("last"), (acc["n"] + F.least(F.lit(3), p + 2 - acc["last"])).alias("n"))
        return F.aggregate(at, zero, grow, lambda acc: acc["n"])

    return F.when(F.size(words) >= 3, _let(_let(windows, repeated), covered)).otherwise(F.lit(0))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus a struct ``__sp_m`` of counts of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    out = docs.select("*", _let(words, of_words).alias("__sp_w"), _let(lines, of_lines).alias("__sp_l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("__sp_s"), F.regexp_count(text, F.lit("!")).cast("long").alias("__sp_b"), F.regexp_count(text, F.lit(r"\|")).cast("long").alias("__sp_p"))
    m = F.struct("__sp_w.n_words", "__sp_w.word_chars", F.col("__sp_s").alias("n_symbols"), "__sp_l.n_dup_lines", "__sp_w.n_repeat_words", "__sp_l.n_lines", F.col("__sp_b").alias("n_bangs"), F.col("__sp_p").alias("n_bars"))
    return out.withColumn("__sp_m", m).drop("__sp_w", "__sp_l", "__sp_s", "__sp_b", "__sp_p")


def _measures() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.col(f"__sp_m.{a}") / F.nullif(F.col(f"__sp_m.{b}"), F.lit(0)), F.lit(0.0))
    return {"symbols_per_char": per("n_symbols", "word_chars"), "dup_lines_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "bangs_per_word": per("n_bangs", "n_words"), "bars_per_word": per("n_bars", "n_words")}


def sketches(rows: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, measure, bucket, n)``: one mergeable sketch per group and measure."""
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    bucket = lambda v: F.when(v > 0, F.ceil(F.log(v) / F.log(F.lit(gamma))).cast("int")).otherwise(F.lit(-(2**30)))
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _measures().items()])
    return rows.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.inline(each)).groupBy("lang", "source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Fences of the sketches merged over everything but ``by``.

    The cumulative count runs within one sketch, which has at most a few thousand buckets whatever the corpus."""
    from pyspark.sql import Window

    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "measure")
    run = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("upto"), F.sum("n").over(w).alias("all"))
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    value = F.when(F.col("bucket") == -(2**30), F.lit(0.0)).otherwise(F.pow(F.lit(gamma), F.col("bucket")) * 2 / (gamma + 1))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), value))
    q = run.groupBy(*by, "measure").agg(at(0.5).alias("q50"), at(0.75).alias("q75"), F.max("all").alias("docs"))
    slack = F.element_at(F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv]), F.col("measure"))
    fence = F.greatest(slack, F.col("q50") + REACH * (F.col("q75") - F.col("q50")))
    return q.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("measure", fence))).alias("fence"), F.max("docs").alias("docs"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``(lang, source, fence map)``: the group's own fences, drawn towards those of the language and of the corpus."""
    own = _quantiles(sketch, ["lang", "source"])
    lang = _quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("fence").alias("lang_fence"), F.col("docs").alias("lang_docs"))
    whole = _quantiles(sketch.withColumn("one", F.lit(1)), ["one"]).select(F.col("fence").alias("corpus_fence"))
    # the right side is one row, by construction
    out = own.join(lang, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(whole), F.lit(True))

    def drawn(k: Column, mine: Column) -> Column:
        of_lang = _drawn(F.element_at("lang_fence", k), F.element_at("corpus_fence", k), F.col("lang_docs"))
        return _drawn(mine, of_lang, F.col("docs"))

    return out.select("lang", "source", F.transform_values("fence", drawn).alias("fence"))


def _drawn(own: Column, parent: Column, n: Column) -> Column:
    return parent + (own - parent) * (n / (n + F.lit(PRIOR)))


def judged(rows: DataFrame, fences: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Measured rows with ``__sp_base_failed`` and ``__sp_kept``.  The fences have a row per group; whether they are broadcast is
    left to Spark's own size check, and AQE splits a hot group otherwise."""
    f = fences.select(F.col("lang").alias("__sp_fl"), F.col("source").alias("__sp_fs"), F.col("fence").alias("__sp_fence"))
    out = rows.join(f, rows[lang_col].eqNullSafe(f["__sp_fl"]) & rows[source_col].eqNullSafe(f["__sp_fs"]), "left")
    n = F.col("__sp_m.n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("__sp_m.n_repeat_words") > MAX_REPEAT_PERCENT * n)
    inside = F.lit(True)
    for name, value in _measures().items():
        inside = inside & (value <= F.element_at("__sp_fence", name))
    return out.withColumn("__sp_base_failed", failed).withColumn("__sp_kept", ~failed & inside).drop("__sp_fl", "__sp_fs", "__sp_fence")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: the base counts, ``base_failed`` and ``kept``."""
    rows = keep(measured(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))).drop("text"), "measures")
    out = judged(rows, keep(thresholds(sketches(rows)), "fences"))
    return out.select("doc_id", *[F.col(f"__sp_m.{c}").alias(c) for c in BASE], F.col("__sp_base_failed").alias("base_failed"), F.col("__sp_kept").alias("kept"))


def apply_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` without the rejected rows, same columns.  The texts are measured once and wait in scratch space."""
    rows = keep(measured(docs, text_col), "measures")
    fences = keep(thresholds(sketches(rows, lang_col, source_col)), "fences")
    return judged(rows, fences, lang_col, source_col).where("__sp_kept").select(*docs.columns)
