"""Unicode forensics of a text column: deceptive and invisible code points with their places, line ends, statistics."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udf import arrow

from ..functions import unicode as U
from ..functions.jsre import utf16_length

BREAK = r"\r\n|\r|\n"
_ENDS = regex.compile(BREAK)
WORD = r"[\p{L}\p{N}][\p{L}\p{N}'’_-]*"
_SPECIAL = f"[{U.special_class()}\\t]"


def code_point(c: Column) -> Column:
    return F.ascii(c)


def notation(cp: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(cp), F.greatest(F.lit(4), F.length(F.hex(cp))), F.lit("0")))


def abbreviation(cp: Column) -> Column:
    """Caret notation of a control, else U+XXXX."""
    return F.when(cp < 32, F.concat(F.lit("^"), F.char(cp + 64))).when(cp == 127, "^?").otherwise(notation(cp))


_FOUND = "array<struct<pos:int,line:int,column:int,cp:int,category:string,name:string,looks_like:string>>"


@lru_cache(maxsize=1)
def _pattern():
    return regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", _SPECIAL))


def scan(text: str | None) -> list[dict]:
    """Every special character of one text with its place, in one pass: offset, 1-based line and column."""
    out, line, start, seen = [], 1, 0, 0
    for m in _pattern().finditer(text or ""):
        at, cp = m.start(), ord(m[0])
        for e in _ENDS.finditer(text, seen, at):
            line, start = line + 1, e.end()
        seen = at
        kind = ("tab", "Tab", None) if cp == 9 else ("bom", "Byte-order mark", None) if cp == 0xFEFF and at == 0 else U.classify(cp)
        if kind:
            out.append({"pos": at, "line": line, "column": at - start + 1, "cp": cp, "category": kind[0], "name": kind[1], "looks_like": kind[2]})
    return out


@arrow(_FOUND)
def _scanned(s: pd.Series) -> pd.Series:
    return s.map(scan)


def findings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per deceptive or invisible character: place (offset, 1-based line and column), category, severity, name.

    Texts without one leave by a native regex before the Arrow pass."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(_SPECIAL))
    at = rows.select("id", F.inline(_scanned("text")))
    meta = F.create_map(*[x for k, v in U.CATEGORIES.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("severity"), F.lit(v[1]).alias("grp"), F.lit(v[2]).alias("label")))])
    m = F.element_at(meta, F.col("category"))
    return at.select("id", "pos", "line", "column", "cp", notation(F.col("cp")).alias("notation"), "category", "name", "looks_like", m["severity"].alias("severity"), m["grp"].alias("grp"), m["label"].alias("label"))


def summaries(found: DataFrame) -> DataFrame:
    """Per document and category, worst first; ``headline`` counts everything but tabs."""
    tier = F.element_at(F.create_map(*[F.lit(x) for kv in {"danger": 0, "warning": 1, "notice": 2, "info": 3}.items() for x in kv]), F.col("severity"))
    g = found.groupBy("id", "category", "severity", "grp", "label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("headline", F.when(F.col("category") != "tab", F.col("n")).otherwise(0)).orderBy("id", tier, F.desc("n"), "label")


def line_endings(text: Column) -> Column:
    """``struct(lf, cr, crlf, dominant, mixed)``; ties: LF, then CRLF, then CR."""
    crlf = F.regexp_count(text, F.lit(r"\r\n"))
    lf, cr = F.regexp_count(text, F.lit(r"\n")) - crlf, F.regexp_count(text, F.lit(r"\r")) - crlf
    most = F.greatest(lf, crlf, cr)
    dominant = F.when(most == 0, "none").when(lf == most, "lf").when(crlf == most, "crlf").otherwise("cr")
    kinds = (lf > 0).cast("int") + (cr > 0).cast("int") + (crlf > 0).cast("int")
    return F.struct(lf.alias("lf"), cr.alias("cr"), crlf.alias("crlf"), dominant.alias("dominant"), (kinds > 1).alias("mixed"))


def trailing_whitespace(text: Column) -> Column:
    """``array<struct(line, n)>`` of lines that end in spaces or tabs."""
    lines = F.transform(F.split(text, BREAK), lambda x, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, r"[ \t]+\z", 0)).alias("n")))
    return F.filter(lines, lambda x: x["n"] > 0)


def graphemes(text: Column) -> Column:
    """User-perceived characters.  A text of ASCII alone has one for each code point, but CR LF is one."""
    plain = F.length(text) - F.regexp_count(text, F.lit("\r\n"))
    return F.when(F.length(text) == F.octet_length(text), plain).otherwise(F.regexp_count(text, F.lit(r"\X"))).cast("long")


def stats(text: Column) -> Column:
    """Counts of a text: code points, UTF-16 units, bytes, graphemes, lines, words, spaces, tabs."""
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return F.struct(F.length(text).cast("long").alias("code_points"), utf16_length(text).cast("long").alias("utf16_units"), F.octet_length(text).cast("long").alias("bytes"), graphemes(text).alias("graphemes"), (n(BREAK) + 1).alias("lines"), n(WORD).alias("words"), n(" ").alias("spaces"), n(r"\t").alias("tabs"))


def reveal(text: str) -> str:
    """The text with what cannot be seen spelled out: ``[ZWSP]``, ``[LF]``; a look-alike stands beside its code point."""

    def shown(m) -> str:
        c = m[0]
        if c in ("\n", "\r", "\r\n"):
            return {"\n": "[LF]", "\r": "[CR]", "\r\n": "[CRLF]"}[c] + "\n"
        if c == "\t":
            return "[TAB]"
        if c == "\ufeff" and m.start() == 0:
            return "[BOM]"
        kind = U.classify(ord(c))
        if kind is None:
            return c
        spelled = f"U+{ord(c):04X}"
        if kind[2] is not None:
            return f"{c}({spelled})"
        caret = f"^{chr(ord(c) + 64)}" if c < " " else "^?" if c == "\x7f" else None
        return f"[{U.SHORT.get(c) or U.SHORT_OF_CATEGORY.get(kind[0]) or caret or spelled}]"

    return regex.sub(rf"\r\n|[\r\n]|{_pattern().pattern}", shown, text)


@arrow("string")
def expanded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else reveal(x))
