"""String semantics shared by all operators: one definition of white space, trimming and word edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ECMAScript counts as white space (Unicode spaces, line ends and U+FEFF, not U+0085), as a class body
#: that Java, Python and RE2 read alike.
WS = r"\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same characters themselves, for translate() and Python.
WS_CHARS = "\t\n\v\f\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
PY_WS = "\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def duck_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def py_trim(x: str) -> str:
    return x.strip(WS_CHARS)


def utf16_length(c: Column) -> Column:
    """UTF-16 code units: code points plus one for each astral character."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"[{WS}]+", " "))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.  The optimizer merges projections and would repeat a costly expression
    wherever it is used; it does not look into a lambda's argument."""
    return F.transform(F.array(value), body)[0]
