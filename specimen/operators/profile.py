"""Profiler of delimited data: typed column profiles, duplicate rows, findings.

Cells are unpivoted once and reduced to a frequency table ``(col, raw, n)``; each distinct value is classified once, and
counts, types, distinctness, exact medians and clusters are weighted aggregates of that table.  Only what needs rows
(samples, anomalies' rows, duplicate rows) goes back to the cells; "first k" uses a window whose limit Spark applies before
its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.jsre import collapse, trim
from .findings import finding, gather

TYPE_DOMINANCE, TEXT_DOMINANCE, MIN_KEY_ROWS, FREE_TEXT_MEAN = 0.85, 0.7, 8, 40
CATEGORICAL_MAX, TOP_VALUES, SAMPLES, EXAMPLES = 200, 12, 5, 12
ID_NAME = r"(?i)(^|[\s_\-.])(id|ids|key|keys|code|codes|number|no|num|uuid|guid|ref|sku|isbn|ssn|account|acct)([\s_\-.]|$)"
STRONG_ID_NAME = r"(?i)(^|[\s_\-.])(id|ids|key|keys|uuid|guid|ssn|sku|isbn)([\s_\-.]|$)"


def to_cells(df: DataFrame, columns: list[str] | None = None, row: Column | None = None) -> DataFrame:
    """Long form ``(row, col, name, raw)``.  ``row``: a number that orders rows; by default their place in the input."""
    names = columns or df.columns
    each = F.array(*[F.struct(F.lit(k).alias("col"), F.lit(c).alias("name"), F.col(c).cast("string").alias("raw")) for k, c in enumerate(names)])
    return df.select((F.monotonically_increasing_id() if row is None else row).cast("long").alias("row"), F.inline(each))


def frequencies(cells: DataFrame) -> DataFrame:
    """``(col, name, raw, n, first_row)`` with the class of each distinct value.  One shuffle, pre-aggregated."""
    f = cells.groupBy("col", "name", F.coalesce("raw", F.lit("")).alias("raw")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    return C.classified(f)


def scan(freq: DataFrame) -> DataFrame:
    """One row per column: blanks by kind, types, lengths, distinctness, padding.  One partially aggregated shuffle: whether
    a column has just two spellings of yes and no is read off a bit mask of the ten that there are."""
    f = freq.withColumn("low", F.lower("raw"))
    n, kind, is_full = F.col("n"), F.col("class"), C.populated(F.col("trimmed"))
    count = lambda p: F.coalesce(F.sum(F.when(p, n)), F.lit(0))
    kinds = [count(kind == k).alias(f"n_{k}") for k in C.VALUE_TYPES]
    bit = F.coalesce(*[F.when(F.col("low") == w, F.lit(1 << k)) for k, w in enumerate(C.BOOLEAN_COLUMN)], F.lit(1 << len(C.BOOLEAN_COLUMN)))
    words = F.bit_or(F.when(is_full, bit))
    return f.groupBy("col", "name").agg(
        F.sum(n).alias("total"),
        count(kind == "empty").alias("n_empty"),
        count(kind == "whitespace").alias("n_whitespace"),
        count(kind == "null-like").alias("n_null_like"),
        count(is_full).alias("populated"),
        *kinds,
        count(is_full & (F.col("raw") != F.col("trimmed"))).alias("n_padded"),
        F.coalesce(F.sum(F.when(is_full, n * F.length("trimmed"))), F.lit(0)).alias("length_sum"),
        F.count_if(is_full).alias("n_distinct"),
        F.coalesce((words < (1 << len(C.BOOLEAN_COLUMN))) & (F.bit_count(words) == 2), F.lit(False)).alias("boolean_shape"),
        F.max(F.when(is_full, n)).alias("top_n"),
        F.array_sort(F.collect_set(F.when(kind == "null-like", F.col("trimmed")))).alias("null_words"),
    )


def dominant(s: DataFrame) -> DataFrame:
    """The scan with ``dominant_type``, ``family`` and ``conformity``; ties go to numbers, dates, booleans, text."""
    pop = F.col("populated")
    fam = {"numeric": F.col("n_integer") + F.col("n_decimal"), "temporal": F.col("n_date") + F.col("n_datetime"), "boolean": F.col("n_boolean"), "text": F.col("n_text")}
    most = F.greatest(*fam.values())
    leader = F.coalesce(*[F.when(v == most, F.lit(k)) for k, v in fam.items()])
    share, text = most / pop, F.col("n_text") / pop
    named = F.when(leader == "numeric", F.when(F.col("n_decimal") > 0, "decimal").otherwise("integer")).when(leader == "temporal", F.when(F.col("n_datetime") > 0, "datetime").otherwise("date")).otherwise(leader)
    kind = F.when(pop == 0, "empty").when(F.col("boolean_shape"), "boolean").when(leader == "text", F.when(share >= TEXT_DOMINANCE, "text").otherwise("mixed")).when(share >= TYPE_DOMINANCE, named).when(text >= TEXT_DOMINANCE, "text").otherwise("mixed")
    conformity = F.when((pop == 0) | F.col("boolean_shape"), 1.0).when((leader != "text") & (share < TYPE_DOMINANCE) & (text >= TEXT_DOMINANCE), text).otherwise(share)
    return s.withColumn("dominant_type", kind).withColumn("conformity", conformity).withColumn("family", C.family(F.col("dominant_type")))


def columns(freq: DataFrame) -> DataFrame:
    """One row per column: the scan, its dominant type, ratios, and whether it might be a key."""
    d = dominant(scan(freq))
    pop = F.col("populated")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = d.withColumns({"completeness": ratio(pop, F.col("total")), "uniqueness": ratio(F.col("n_distinct"), pop), "mean_length": ratio(F.col("length_sum"), pop), "is_constant": (pop > 0) & (F.col("n_distinct") == 1), "categorical": F.col("n_distinct") <= CATEGORICAL_MAX})
    free = (F.col("dominant_type") == "text") & (F.col("mean_length") > FREE_TEXT_MEAN)
    no = (pop < MIN_KEY_ROWS) | (F.col("completeness") < 0.98) | (F.col("uniqueness") < 0.98) | free
    sure = (F.col("completeness") == 1) & (F.col("uniqueness") == 1) & trim(F.col("name")).rlike(ID_NAME)
    return d.withColumn("candidate_key", F.when(no, "none").when(sure, "strong").otherwise("possible"))


#: Ranges of values that a column is cut into for its median: each is sorted by a task of its own.
RANGES = 16


def numeric_stats(freq: DataFrame) -> DataFrame:
    """Per column with numbers: count, extremes, mean, exact median, zeros, negatives, formatted ones.

    No task holds all values of a column: they are cut into ``RANGES`` by a quantile sketch of the distinct values, each range
    has a running count of its own (sorted, so it may spill), and the counts of the ranges before it are added.  All three
    uses of the frequencies ask for the same columns, so that their shuffle is made once and reused."""
    got = freq.where((F.col("n") > 0) & C.populated(F.col("trimmed"))).where("num is not null")
    v = got.select("col", "name", "n", F.col("num.value").alias("v"), F.col("num.formatted").alias("formatted"))
    sketch = v.groupBy("col").agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("cuts"))
    place = sum(((F.get("cuts", F.lit(k)) < F.col("v")).cast("int") for k in range(RANGES - 1)), F.lit(0))
    cut = v.join(F.broadcast(sketch), "col").select("col", "name", "v", "n", "formatted", place.alias("range"))
    run = cut.withColumn("upto", F.sum("n").over(Window.partitionBy("col", "name", "range").orderBy("v")))  # equal values are peers
    sums = cut.groupBy("col", "range").agg(F.sum("n").alias("n"))
    before = sums.select("col", "range", (F.sum("n").over(Window.partitionBy("col").orderBy("range")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("col")).alias("all"))
    at = run.join(F.broadcast(before), ["col", "range"]).withColumn("rank", F.col("before") + F.col("upto"))
    n, value = F.col("n"), F.col("v")
    count = lambda p: F.coalesce(F.sum(F.when(p, n)), F.lit(0))
    middle = lambda r: F.min(F.when(F.col("rank") >= F.expr(r), value))
    out = at.groupBy("col", "name").agg(F.sum("n").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), (F.sum(value * n) / F.sum(n)).alias("mean"), middle("(`all` + 1) div 2").alias("low"), middle("`all` div 2 + 1").alias("high"), count(value == 0).alias("zeros"), count(value < 0).alias("negatives"), count(F.col("formatted")).alias("formatted"))
    return out.select("col", "name", "count", "min", "max", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "zeros", "negatives", "formatted")


def date_stats(freq: DataFrame) -> DataFrame:
    """Per column with dates: first and last as written (of equal instants the first row's), parse rate, any time of day."""
    p = freq.where(C.populated(F.col("trimmed")))
    is_date = F.col("at").isNotNull()
    out = p.groupBy("col", "name").agg(F.sum(F.when(is_date, F.col("n"))).alias("parsed"), F.sum("n").alias("populated"), F.min_by("trimmed", F.when(is_date, F.struct("at.at", "first_row"))).alias("earliest"), F.max_by("trimmed", F.when(is_date, F.struct("at.at", -F.col("first_row")))).alias("latest"), F.bool_or(F.col("at.has_time")).alias("has_time"))
    return out.where("parsed > 0").select("col", "name", "parsed", (F.col("parsed") / F.col("populated")).alias("parse_rate"), "earliest", "latest", "has_time")


def _first(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def top_values(freq: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The most frequent values of categorical columns: ``(col, name, rank, raw, n)``."""
    populated = freq.where(C.populated(F.col("trimmed")))
    few = populated.groupBy("col").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= CATEGORICAL_MAX).select("col")
    return _first(populated.join(few, "col", "left_semi"), ["col", "name"], [F.desc("n"), "raw"], k).select("col", "name", "rank", "raw", "n")


def samples(cells: DataFrame, k: int = SAMPLES) -> DataFrame:
    """The first ``k`` populated cells of each column in row order."""
    populated = cells.withColumn("trimmed", trim(F.coalesce("raw", F.lit("")))).where((F.col("trimmed") != "") & ~F.col("trimmed").isin(C.NULL_LIKE))
    return _first(populated, ["col", "name"], ["row"], k).select("col", "name", "rank", "row", "raw")


def anomalies(freq: DataFrame, profile: DataFrame) -> DataFrame:
    """Distinct populated values outside their column's dominant family: ``(col, name, raw, class, n, first_row)``."""
    p = profile.where("family is not null and not boolean_shape").select("col", "family")
    rows = freq.where(C.populated(F.col("trimmed"))).join(F.broadcast(p), "col")  # a row per column
    return rows.where(C.family(F.col("class")) != F.col("family")).select("col", "name", "raw", "class", "n", "first_row")


def duplicate_rows(df: DataFrame, columns: list[str] | None = None, row: Column | None = None) -> DataFrame:
    """Groups of equal rows that are not blank: ``(fields, n, first_row)``.  Grouped on the fields themselves."""
    names = columns or df.columns
    fields = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    at = (F.monotonically_increasing_id() if row is None else row).cast("long")
    rows = df.select(at.alias("row"), fields.alias("fields")).where(F.exists("fields", lambda x: trim(x) != ""))
    return rows.groupBy("fields").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row")).where("n > 1")


def repeated_values(cells: DataFrame, freq: DataFrame, names: list[str] | None = None, values: int = EXAMPLES, rows: int = 6) -> DataFrame:
    """Values that repeat within a column, the most frequent first, with the first rows that carry them:
    ``(col, name, raw, n, rows)``.  Only the few chosen values are joined back to the cells."""
    v = freq.where((F.col("n") > 1) & C.populated(F.col("trimmed")))
    v = _first(v if names is None else v.where(F.col("name").isin(names)), ["col", "name"], [F.desc("n"), "raw"], values).select("col", "name", "raw", "n")
    hit = cells.select("row", "col", F.coalesce("raw", F.lit("")).alias("raw")).join(v, ["col", "raw"])
    return _first(hit, ["col", "name", "raw", "n"], ["row"], rows).groupBy("col", "name", "raw", "n").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _loose(raw: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(raw), r"""[.,&/'"()\[\]_\-]""", ""))


def clusters(freq: DataFrame, kind: str) -> DataFrame:
    """Values of one column that may be the same: ``caps`` (only case differs), ``loose`` (marks or inner spaces differ) or
    ``whitespace`` (padded beside clean): ``(col, name, key, variants, n)``."""
    v = freq.where(C.populated(F.col("trimmed")))
    if kind == "caps":
        g = v.groupBy("col", "name", F.lower("raw").alias("key")).agg(F.sort_array(F.collect_list("raw")).alias("variants"), F.sum("n").alias("n"))
        return g.where(F.size("variants") > 1)
    if kind == "loose":
        g = v.withColumn("key", _loose(F.col("raw"))).where("key != ''").groupBy("col", "name", "key").agg(F.sort_array(F.collect_list("raw")).alias("variants"), F.sum("n").alias("n"), F.count_distinct(F.lower("trimmed")).alias("lowers"))
        return g.where((F.size("variants") > 1) & (F.col("lowers") > 1)).drop("lowers")
    g = v.groupBy("col", "name", F.col("trimmed").alias("key")).agg(F.sort_array(F.collect_list("raw")).alias("variants"), F.sum("n").alias("n"), F.count_if(F.col("raw") != F.col("trimmed")).alias("padded"), F.count_if(F.col("raw") == F.col("trimmed")).alias("clean"))
    return g.where("padded > 0 and clean > 0").drop("padded", "clean")


def overview(profile: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row on the whole table."""
    p = profile.agg(F.count(F.lit(1)).alias("n_columns"), F.max("total").alias("n_rows"), F.sum("total").alias("n_cells"), F.sum("populated").alias("n_populated"), F.count_if(F.col("candidate_key") != "none").alias("n_key_candidates"))
    d = duplicates.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.count(F.lit(1)).alias("duplicate_groups"))
    return p.crossJoin(d)  # one row beside one row


def preview(df: DataFrame, rows: int = 50, cols: int = 40) -> DataFrame:
    """The first rows of the first columns, each with what to mark: ``blank`` rows, and per cell the kinds of blank."""
    shown = df.columns[:cols]
    kinds = F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", "empty").when(trim(F.col(c).cast("string")) == "", "whitespace").when(trim(F.col(c).cast("string")).isin(C.NULL_LIKE), "null-like") for c in shown])
    rest = [trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    return df.select(*shown, kinds.alias("blank_kinds"), (F.concat(*rest) == "").alias("blank_row")).limit(rows)


CATEGORY = {"structure": 0, "headers": 1, "uniqueness": 2, "type-integrity": 3, "completeness": 4, "duplicates": 5, "consistency": 6, "whitespace": 7}


def _column_rules(p: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Findings that a column's profile alone decides: all of them in one projection.  Repeated values are a finding of columns
    that look like keys, being unique but for a few values, and of those that the caller names as ``keys``, however many repeat."""
    pct = lambda x: F.format_string("%.1f%%", x * 100)
    u, pop = F.col("uniqueness"), F.col("populated")
    named = trim(F.col("name")).rlike(STRONG_ID_NAME)
    free = (F.col("dominant_type") == "text") & (F.col("mean_length") > FREE_TEXT_MEAN)
    repeated = (pop >= MIN_KEY_ROWS) & (F.col("completeness") >= 0.95) & ~free & (((u >= 0.9) & (u < 1) & named) | ((u >= 0.98) & (u < 1)))
    told = F.col("name").isin(keys or []) & (pop > 0)
    rules = [
        (repeated | (told & (u < 1)), "uniqueness", "dupkey", "warning", F.when(told, "An identifier has repeated values").otherwise("A likely identifier has repeated values"), F.concat(F.lit("Unique in "), pct(u), F.lit(" of the values.")), pop - F.col("n_distinct")),
        (((F.col("candidate_key") != "none") | told) & (u == 1), "uniqueness", "candidatekey", "info", F.lit("Could identify rows"), F.lit("Every value is different."), F.col("n_distinct")),
        (F.col("dominant_type") == "mixed", "type-integrity", "mixed", "info", F.lit("No type prevails"), F.lit("The column holds several kinds of values."), pop),
        ((pop == 0) & (F.col("total") > 0), "completeness", "empty", "notice", F.lit("No values"), F.lit("Every cell is blank."), F.col("total")),
        ((pop > 0) & (F.col("completeness") <= 0.1), "completeness", "sparse", "notice", F.lit("Mostly blank"), F.concat(F.lit("Only "), pct(F.col("completeness")), F.lit(" of the cells have a value.")), F.col("total") - pop),
        ((pop >= 4) & (F.col("n_distinct") == 1), "consistency", "constant", "info", F.lit("One value only"), F.lit("Every populated cell is the same."), pop),
        ((pop >= 4) & (F.col("n_distinct") > 1) & (F.col("top_n") / pop >= 0.95), "consistency", "nearconstant", "info", F.lit("Nearly one value only"), F.concat(F.lit("One value fills "), pct(F.col("top_n") / F.nullif(pop, F.lit(0))), F.lit(".")), F.col("top_n")),
        (F.col("n_padded") > 0, "whitespace", "padded", "notice", F.lit("Spaces around values"), F.lit("Joins and comparisons will treat them as different."), F.col("n_padded")),
        (F.col("n_whitespace") > 0, "whitespace", "only", "notice", F.lit("Cells of white space alone"), F.lit("They look empty and are not."), F.col("n_whitespace")),
    ]
    fired = [F.when(when, F.struct(_rule(cat, what).alias("id"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"), title.alias("title"), detail.alias("detail"), n.cast("bigint").alias("n"))) for when, cat, what, sev, title, detail, n in rules]
    return p.select(F.col("name").alias("subject"), F.inline(F.array_compact(F.array(*fired))))


def _rule(cat: str, what: str) -> Column:
    return F.format_string(f"{cat}-%d-{what}", F.col("col"))


def _first_shown(rows: DataFrame, by: list[str], order: list, text: Column) -> DataFrame:
    """The first examples of each group, one more than are shown; Spark limits the ranks before it shuffles them."""
    some = _first(rows, by, order, EXAMPLES + 1)
    return some.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("x")))), lambda e: e["x"]).alias("ex"))


def find(freq: DataFrame, profile: DataFrame, duplicates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All findings on columns, values and rows; ``keys`` are columns known to identify rows.  ``profile`` has a row per column, so it is fetched and sent back as it is."""
    spark = freq.sparkSession
    p = spark.createDataFrame(profile.collect(), profile.schema)
    subject, whole, parts = F.col("name"), F.lit(None).cast("string"), []
    of_columns = _column_rules(p, keys)
    parts.append(finding(of_columns, F.col("subject"), F.col("id"), F.col("severity"), F.col("category"), F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv]), F.col("category")), F.col("title"), F.col("detail"), F.col("n")))
    # what does not read like the rest of its column: how many follows from the profile, which from the frequencies
    same = F.when(F.col("family") == "numeric", F.col("n_integer") + F.col("n_decimal")).when(F.col("family") == "temporal", F.col("n_date") + F.col("n_datetime")).when(F.col("family") == "boolean", F.col("n_boolean")).when(F.col("family") == "text", F.col("n_text"))
    odd = p.where("family is not null and not boolean_shape and dominant_type not in ('mixed', 'empty')").withColumn("odd", F.col("populated") - same).where("odd > 0")
    shown = _first_shown(anomalies(freq, p), ["col"], ["first_row"], F.col("raw"))
    few = F.col("odd") <= F.greatest(F.lit(3), F.floor(F.col("populated") * 0.02 + 0.5))
    parts.append(finding(shown.join(F.broadcast(odd), "col"), subject, _rule("type-integrity", "anomaly"), F.when(few, "warning").otherwise("notice"), "type-integrity", CATEGORY["type-integrity"], F.concat(F.lit("Not "), F.col("dominant_type")), "Some values do not read like the rest of the column.", F.col("odd"), F.col("ex")))
    # clusters of all three kinds, of categorical columns (so of few values each): one aggregate, then one per column
    keyed = freq.where(C.populated(F.col("trimmed"))).join(F.broadcast(p.where("categorical").select("col", F.col("dominant_type").isin("text", "mixed").alias("wordy"))), "col")
    kinds = F.array(F.when(F.col("wordy"), F.struct(F.lit("caps").alias("kind"), F.lower("raw").alias("key"))), F.when(F.col("wordy"), F.struct(F.lit("loose").alias("kind"), _loose(F.col("raw")).alias("key"))), F.struct(F.lit("whitespace").alias("kind"), F.col("trimmed").alias("key")))
    each = keyed.select("col", "name", "raw", "trimmed", "n", F.inline(F.array_compact(kinds))).where("key != ''")
    g = each.groupBy("kind", "col", "name", "key").agg(F.sort_array(F.collect_list("raw")).alias("variants"), F.sum("n").alias("n"), F.count_distinct(F.lower("trimmed")).alias("lowers"), F.bool_or(F.col("raw") != F.col("trimmed")).alias("padded"), F.bool_or(F.col("raw") == F.col("trimmed")).alias("clean"))
    g = g.where("(kind = 'caps' and size(variants) > 1) or (kind = 'loose' and size(variants) > 1 and lowers > 1) or (kind = 'whitespace' and padded and clean)")
    w = Window.partitionBy("kind", "col", "name")
    some = g.withColumn("k", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "key"))).where(F.col("rank") <= EXAMPLES + 1)
    some = some.groupBy("kind", "col", "name").agg(F.max("k").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("rank", F.array_join(F.slice("variants", 1, 6), " · ").alias("x")))), lambda e: e["x"]).alias("ex"))
    told = F.create_map(*[x for k, (cat, what, title) in {"caps": ("consistency", "caps", "Values differ only by case"), "loose": ("consistency", "similar", "Values look alike"), "whitespace": ("whitespace", "variants", "Padded and clean spellings of one value")}.items() for x in (F.lit(k), F.struct(F.lit(cat).alias("cat"), F.lit(what).alias("what"), F.lit(title).alias("title"), F.lit(CATEGORY[cat]).alias("place")))])
    m = F.element_at(told, F.col("kind"))
    parts.append(finding(some, subject, F.format_string("%s-%d-%s", m["cat"], F.col("col"), m["what"]), "notice", m["cat"], m["place"], m["title"], "They may mean the same.", F.col("k"), F.col("ex")))
    like = p.agg(F.sum("n_null_like").alias("k"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("null_words")))).alias("ex")).where("k > 0")
    parts.append(finding(like, whole, F.lit("completeness-ds-nulllike"), "info", "completeness", CATEGORY["completeness"], "Words that stand for no value", "They were counted as blank.", F.col("k"), F.col("ex")))
    d = duplicates.agg(F.sum(F.col("n") - 1).alias("k")).where("k > 0")
    parts.append(finding(d, whole, F.lit("duplicates-ds-rows"), "warning", "duplicates", CATEGORY["duplicates"], "Rows that repeat", "Exact copies of an earlier row.", F.col("k")))
    return gather(spark, parts)


def profile_table(df: DataFrame, names: list[str] | None = None, row: Column | None = None, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """Everything about a table.  The frequency table is cached, since all results derive from it: when they have been read,
    release it with ``profile["frequencies"].unpersist()``."""
    freq = frequencies(to_cells(df, names, row)).cache()
    cols = columns(freq)
    dups = duplicate_rows(df, names, row)
    return {"frequencies": freq, "columns": cols, "numeric": numeric_stats(freq), "dates": date_stats(freq), "top_values": top_values(freq), "duplicates": dups, "overview": overview(cols, dups), "findings": find(freq, cols, dups, keys)}
