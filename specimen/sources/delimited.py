"""Delimited text as rows: a tokenizer that keeps everything, header detection, and what is wrong with the structure.

Two ways in.  ``read_rows`` takes whole texts (one per row: a file, or a column) through a state machine in an Arrow pass;
quoted line breaks, doubled quotes, ragged rows and blank rows are kept.  ``read_lines`` is for files too large for one
text: it needs a known delimiter and no line breaks inside quotes, and is split by Spark like any text source.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.jsre import trim
from ..operators.findings import finding, gather
from ..operators.profile import CATEGORY

DELIMITERS = {",": "comma", "\t": "tab", "|": "pipe", ";": "semicolon", "\x1e": "record separator", "\x1f": "unit separator"}
GUESS_ROWS, HEADER_ROWS = 10, 50


def line_breaks(text: Column) -> Column:
    """lf, crlf, cr, mixed or none."""
    crlf = F.regexp_count(text, F.lit(r"\r\n"))
    lf, cr = F.regexp_count(text, F.lit(r"\n")) - crlf, F.regexp_count(text, F.lit(r"\r")) - crlf
    kinds = (lf > 0).cast("int") + (cr > 0).cast("int") + (crlf > 0).cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").otherwise("cr")


def delimiter_name(d: str) -> str:
    return DELIMITERS.get(d, "none" if not d else "space" if d == " " else repr(d))


def tokenize(text: str, delimiter: str) -> tuple[list[list[str]], list[int]]:
    """``(rows, numbers of rows with a quote at fault)``.  A quote opens a field only at its start; a doubled one is one.

    Text behind a closing quote is kept and the row named; a quote that never closes takes the rest of the text."""
    rows: list[list[str]] = []
    faults: list[int] = []
    i, n, row = 0, len(text), []
    plain = re.compile(f"[^{re.escape(delimiter)}\r\n]*") if delimiter else re.compile("[^\r\n]*")
    while i <= n:
        if i < n and text[i] == '"':
            out, at = [], i + 1
            while True:
                q = text.find('"', at)
                if q < 0:
                    out.append(text[at:])
                    faults.append(len(rows))
                    i = n
                    break
                out.append(text[at:q])
                if text[q + 1 : q + 2] == '"':
                    out.append('"')
                    at = q + 2
                    continue
                i = q + 1
                break
            rest = plain.match(text, i)
            if rest[0]:
                faults.append(len(rows))
            row.append("".join(out) + rest[0])
            i = rest.end()
        else:
            m = plain.match(text, i)
            row.append(m[0])
            i = m.end()
        if i < n and delimiter and text[i] == delimiter:
            i += 1
            continue
        rows.append(row)
        row = []
        if i >= n:
            break
        i += 2 if text.startswith("\r\n", i) else 1
    return rows, sorted(set(faults))


def guess_delimiter(text: str) -> str:
    """The candidate whose first rows agree best on a number of fields above one; none: empty."""
    best, score = "", 0.0
    head = "".join(text.splitlines(keepends=True)[:GUESS_ROWS])
    for d in DELIMITERS:
        sizes = [len(r) for r in tokenize(head, d)[0] if r != [""]]
        if sizes and (mean := sum(sizes) / len(sizes)) > 1.5:
            spread = sum(abs(s - mean) for s in sizes) / len(sizes)
            if mean / (1 + 4 * spread) > score:
                best, score = d, mean / (1 + 4 * spread)
    return best


def parse(text: str | None, delimiter: str | None = None) -> dict:
    """One text: ``bom``, ``delimiter``, ``rows``, ``faults``; an empty last row, which a final line break leaves, is dropped."""
    body = (text or "").removeprefix("﻿")
    d = guess_delimiter(body) if delimiter is None else delimiter
    rows, faults = tokenize(body, d) if body else ([], [])
    if rows and rows[-1] == [""]:
        rows.pop()
    return {"bom": (text or "").startswith("﻿"), "delimiter": d, "rows": rows, "faults": [f for f in faults if f < len(rows)]}


_ROWS = "id long, row long, fields array<string>, delimiter string, bom boolean, quote_fault boolean"


def read_rows(df: DataFrame, id_col: str, text_col: str, delimiter: str | None = None) -> DataFrame:
    """``(id, row, fields, …)``: every row of every text, the header among them as row 0."""

    def run(batches):
        names = [x.split()[0] for x in _ROWS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_()]
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = parse(t, delimiter)
                bad = set(p["faults"])
                for lo in range(0, len(p["rows"]), 10_000):
                    part = p["rows"][lo : lo + 10_000]
                    n = len(part)
                    cols = [[d] * n, range(lo, lo + n), part, [p["delimiter"]] * n, [p["bom"]] * n, [k in bad for k in range(lo, lo + n)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _ROWS)


def read_files(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Whole files, numbered by a hash of their path."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("id"), F.col("value"))
    return read_rows(files, "id", "value", delimiter)


def read_lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Lines of files of any size, split natively: quoted fields may hold the delimiter, not line breaks.

    A lone quote inside an unquoted field is kept; use ``read_rows`` where quotes are at fault."""
    d = re.escape(delimiter)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", r"\A\x{FEFF}", "").alias("v"))
    field = rf'(?:^|{d})("(?:[^"]|"")*"|[^{d}]*)'
    got = F.regexp_extract_all("v", F.lit(field), 1)
    fields = F.transform(got, lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return lines.select("row", fields.alias("fields"))


def is_blank(fields: Column) -> Column:
    return F.forall(fields, lambda x: trim(x) == "")


def headers(rows: DataFrame) -> DataFrame:
    """Per text: ``has_header``, ``detected`` (a text cell over a typed column) or ``assumed`` (all text, all different).

    Looks at row 0 and at most ``HEADER_ROWS`` rows below it, blank rows aside."""
    kept = rows.where(~is_blank(F.col("fields")))
    head = kept.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("row"))).where(F.col("rank") <= HEADER_ROWS + 1)
    cells = C.classified(head.select("id", "rank", F.posexplode("fields").alias("col", "raw")))
    top, body = cells.where("rank = 1"), cells.where("rank > 1")
    typed = body.groupBy("id", "col").agg(F.count_if(~F.col("class").isin("empty", "whitespace", "null-like")).alias("filled"), F.count_if(F.col("class").isin("integer", "decimal", "boolean", "date", "datetime")).alias("typed"))
    t = top.join(typed, ["id", "col"], "left")
    contrast = (F.col("class") == "text") & (F.col("filled") >= 3) & (F.col("typed") / F.col("filled") >= 0.7)
    g = t.groupBy("id").agg(F.count_if(contrast).alias("contrasts"), (F.bool_and(F.col("class") == "text") & (F.count_distinct(F.lower("trimmed")) == F.count(F.lit(1)))).alias("plain"))
    alone = head.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("alone"))
    g = g.join(alone, "id")
    detected = (F.col("contrasts") > 0) | (F.col("alone") & F.col("plain"))
    return g.select("id", (detected | F.col("plain")).alias("has_header"), detected.alias("detected"), (F.col("plain") & ~detected).alias("assumed"))


def structure(rows: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Per text: header, columns (the usual row length; of equals the longer), rows, blank, ragged and faulty rows."""
    r = rows.join(headers(rows), "id", "left").withColumn("blank", is_blank(F.col("fields"))).withColumn("size", F.size("fields"))
    sizes = r.where("not blank").groupBy("id", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.max_by("size", F.struct("n", "size")).alias("n_columns"))
    r = r.join(sizes, "id", "left")
    data = F.col("row") >= F.coalesce(F.col("has_header").cast("int"), F.lit(0))
    inside = data if max_rows is None else data & (F.col("row") - F.coalesce(F.col("has_header").cast("int"), F.lit(0)) < max_rows)
    return r.groupBy("id").agg(F.first("delimiter").alias("delimiter"), F.first("bom").alias("bom"), F.coalesce(F.first("has_header"), F.lit(False)).alias("has_header"), F.coalesce(F.first("assumed"), F.lit(False)).alias("assumed"), F.first("n_columns").alias("n_columns"), F.count_if(data).alias("total_rows"), F.count_if(inside).alias("n_rows"), F.count_if(inside & F.col("blank")).alias("n_blank"), F.count_if(inside & ~F.col("blank") & (F.col("size") != F.col("n_columns"))).alias("n_ragged"), F.count_if("quote_fault").alias("n_quote_faults"), (F.count_if(data) > F.count_if(inside)).alias("truncated"))


def column_names(rows: DataFrame, about: DataFrame) -> DataFrame:
    """``(id, col, name, synthesized)``: the header's names, or ``Column N``."""
    head = rows.where("row = 0").select("id", F.col("fields").alias("head"))
    a = about.join(head, "id").withColumn("col", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("n_columns", F.size("head")), F.lit(1)) - 1)))
    name = F.when(F.col("has_header"), F.coalesce(F.get("head", "col"), F.lit("")))
    blank = name.isNull() | (trim(name) == "")
    return a.select("id", "col", F.when(blank, F.concat(F.lit("Column "), F.col("col") + 1)).otherwise(name).alias("name"), (~F.col("has_header")).alias("synthesized"), name.alias("raw_name"))


def data_cells(rows: DataFrame, about: DataFrame, names: DataFrame) -> DataFrame:
    """``(id, row, col, name, raw)`` for the profiler: missing fields are empty, fields beyond the columns are left out."""
    r = rows.join(about.select("id", "has_header", "n_columns"), "id").where("row >= cast(has_header as int)")
    each = r.select("id", "row", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda k: F.coalesce(F.get(F.col("fields"), k), F.lit("")))).alias("col", "raw"))
    return each.join(names.select("id", "col", "name"), ["id", "col"]).select("id", "row", "col", "name", "raw")


def find(about: DataFrame, names: DataFrame) -> DataFrame:
    """Findings on structure and headers, ``subject`` being the text's id."""
    s, parts = F.col("id"), []

    def out(rows, rule, sev, cat, title, detail, n, ex=None):
        parts.append(finding(rows, s, F.lit(rule), sev, cat, CATEGORY[cat], title, detail, n, ex))

    one = F.lit(1)
    out(about.where("n_ragged > 0"), "structure-ds-rowshape", "warning", "structure", "Rows of another length", "Their fields may be shifted.", F.col("n_ragged"))
    out(about.where("n_quote_faults > 0"), "structure-ds-quotes", "warning", "structure", "Quotes at fault", "A quote is not closed, or text follows it.", F.col("n_quote_faults"))
    out(about.where("delimiter = ''"), "structure-ds-delimiter", "notice", "structure", "No delimiter found", "The text was read as one column.", one)
    out(about.where("n_blank > 0"), "structure-ds-blankrows", "info", "structure", "Blank rows", "Rows without a value.", F.col("n_blank"))
    out(about.where("not has_header"), "structure-ds-noheader", "info", "structure", "No header", "Columns are numbered.", one)
    out(about.where("assumed"), "structure-ds-headerassumed", "info", "structure", "The header is assumed", "Nothing sets the first row apart but its names.", one)
    out(about.where("bom"), "structure-ds-bom", "info", "structure", "A byte-order mark", "It was left out.", one)
    out(about.where("delimiter not in ('', ',') and n_columns > 1"), "structure-ds-nonComma", "info", "structure", "Not separated by commas", F.concat(F.lit("The delimiter is "), F.create_map(*[F.lit(x) for kv in DELIMITERS.items() for x in kv])[F.col("delimiter")], F.lit(".")), one)
    out(about.where("truncated"), "structure-ds-truncated", "notice", "structure", "Rows beyond the limit", "They were not looked at.", F.col("total_rows") - F.col("n_rows"))
    h = names.where("not synthesized").withColumn("t", trim(F.coalesce("raw_name", F.lit(""))))
    tally = lambda rows: rows.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list("t")).alias("ex"))
    same = h.where("t != ''").groupBy("id", "t").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out(tally(same), "headers-ds-duplicate", "warning", "headers", "Column names repeat", "References to them are ambiguous.", F.col("k"), F.col("ex"))
    case = h.where("t != ''").groupBy("id", F.lower("t").alias("low")).agg(F.count_distinct("t").alias("c"), F.min("t").alias("t")).where("c > 1")
    out(tally(case), "headers-ds-caseDuplicate", "notice", "headers", "Column names differ only by case", "They may be meant to be one.", F.col("k"), F.col("ex"))
    out(tally(h.where("t = ''")), "headers-ds-blank", "notice", "headers", "Columns without a name", "They were numbered.", F.col("k"))
    out(tally(h.where("t != '' and t != raw_name")), "headers-ds-whitespace", "notice", "headers", "Spaces around column names", "Lookups by the bare name miss them.", F.col("k"), F.col("ex"))
    return gather(about.sparkSession, parts)
