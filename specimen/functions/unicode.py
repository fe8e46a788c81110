"""Code points that deceive or cannot be seen: a dimension of categories, and character classes for regexes.

Names come from the Unicode database; only what it cannot tell (categories of look-alikes, what they look like) is listed.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Category -> (severity, group, label).
CATEGORIES = {
    "tab": ("info", "whitespace", "Tab"),
    "unusual-space": ("warning", "whitespace", "Unusual space"),
    "vertical-whitespace": ("warning", "whitespace", "Vertical / separator whitespace"),
    "zero-width": ("warning", "invisible", "Zero-width / format"),
    "soft-hyphen": ("notice", "invisible", "Soft hyphen"),
    "bom": ("notice", "invisible", "Byte-order mark"),
    "bidi": ("danger", "invisible", "Bidirectional control"),
    "control": ("warning", "invisible", "Control character"),
    "variation-selector": ("warning", "invisible", "Variation selector"),
    "tag": ("danger", "invisible", "Tag character"),
    "private-use": ("warning", "invisible", "Private-use character"),
    "noncharacter": ("warning", "invisible", "Noncharacter"),
    "blank": ("warning", "invisible", "Blank / filler"),
    "replacement": ("notice", "invisible", "Replacement / object marker"),
    "confusable-quote": ("notice", "confusable", "Curly quote / apostrophe"),
    "confusable-dash": ("notice", "confusable", "Dash / hyphen variant"),
    "confusable-punctuation": ("notice", "confusable", "Confusable punctuation"),
    "confusable-letter": ("warning", "confusable", "Homoglyph letter"),
}
#: Look-alikes, category -> {what it looks like: characters}.
LOOKALIKES = {
    "confusable-quote": {"'": "‘’‛′‵ʼʻ´", '"': "“”„‟″«»", ",": "‚", "<": "‹", ">": "›"},
    "confusable-dash": {"-": "‐‑‒–—―−－⁃", "--": "⸺", "---": "⸻"},
    "confusable-punctuation": {"...": "…", ".": "․", "/": "⁄∕", ";": ";", "·": "··‧", ":": "∶꞉"},
    "confusable-letter": {
        "a": "а", "e": "е", "o": "оο", "p": "р", "c": "с", "y": "у", "x": "х", "i": "і", "j": "ј", "s": "ѕ",
        "A": "АΑ", "B": "ВΒ", "E": "ЕΕ", "K": "КΚ", "M": "МΜ", "H": "НΗ", "O": "ОΟ", "P": "РΡ", "C": "С", "T": "ТΤ", "X": "ХΧ", "I": "Ι", "N": "Ν", "Z": "Ζ",
    },
}
#: Short names of characters that cannot be seen.
SHORT = {
    "\xa0": "NBSP", "\u1680": "OGSP", "\u2000": "NQSP", "\u2001": "MQSP", "\u2002": "ENSP", "\u2003": "EMSP", "\u2004": "3/M", "\u2005": "4/M", "\u2006": "6/M",
    "\u2007": "FIGSP", "\u2008": "PUNSP", "\u2009": "THSP", "\u200a": "HRSP", "\u202f": "NNBSP", "\u205f": "MMSP", "\u3000": "IDSP",
    "\x0b": "VT", "\x0c": "FF", "\x85": "NEL", "\u2028": "LSEP", "\u2029": "PSEP", "\u200b": "ZWSP", "\u200c": "ZWNJ", "\u200d": "ZWJ", "\u2060": "WJ",
    "\u2061": "f()", "\u2062": "(×)", "\u2063": "(,)", "\u2064": "(+)", "\u034f": "CGJ", "\u180e": "MVS", "\ufeff": "ZWNBSP", "\u115f": "HCF", "\u1160": "HJF",
    "\u3164": "HF", "\uffa0": "HHF", "\u2800": "BRZ", "\xad": "SHY", "\u061c": "ALM", "\u200e": "LRM", "\u200f": "RLM", "\u202a": "LRE", "\u202b": "RLE",
    "\u202c": "PDF", "\u202d": "LRO", "\u202e": "RLO", "\u2066": "LRI", "\u2067": "RLI", "\u2068": "FSI", "\u2069": "PDI", "\ufe0e": "VS15", "\ufe0f": "VS16",
    "\ufffc": "OBJ", "\ufffd": "REPL",
}
#: Short names of categories, for characters without one of their own.
SHORT_OF_CATEGORY = {"unusual-space": "SP", "vertical-whitespace": "VWS", "zero-width": "ZW", "bidi": "BIDI", "variation-selector": "VS", "tag": "TAG", "private-use": "PUA", "noncharacter": "NCHR", "blank": "BLANK"}
#: What typographic quotes and dashes are cleaned to.
CLEAN_QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"'}
CLEAN_DASHES = "‐‑‒–—―−－"
SPACES = "\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "  　"
NBSP = "\xa0 "
#: Characters of a category that the Unicode properties below would not put there.
LISTED = {"vertical-whitespace": "\x0b\x0c\x85  ", "zero-width": "​‌‍⁠⁡⁢⁣⁤͏᠎﻿", "blank": "ᅟᅠㅤﾠ⠀", "soft-hyphen": "\xad", "replacement": "￼�"}
BIDI = [(0x61C, 0x61C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)]
VARIATION = [(0x180B, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
TAGS = [(0xE0000, 0xE007F)]
#: Default-ignorable code points that are not format characters (Unicode, DerivedCoreProperties).
IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x2065, 0x2065), (0x3164, 0x3164), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]


def _within(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= z for a, z in ranges)


def java_class(ranges: list[tuple[int, int]] | str) -> str:
    """The body of a character class that Java and RE2 read."""
    pairs = [(ord(c), ord(c)) for c in ranges] if isinstance(ranges, str) else ranges
    return "".join(f"\\x{{{a:X}}}" if a == z else f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in pairs)


_LOOKS = {c: (cat, like) for cat, m in LOOKALIKES.items() for like, chars in m.items() for c in chars}
_LISTED = {c: cat for cat, chars in LISTED.items() for c in chars}


@lru_cache(maxsize=65536)
def classify(cp: int) -> tuple[str, str, str | None] | None:
    """``(category, name, looks like)`` of a code point, or None for ordinary ones and for space, tab, LF, CR."""
    if cp in (9, 10, 13, 32):
        return None
    c = chr(cp)
    name = unicodedata.name(c, "").capitalize()
    if c in SPACES:
        return "unusual-space", name, None
    if c in _LISTED:
        return _LISTED[c], name or "Control character", None
    if c in _LOOKS:
        return _LOOKS[c][0], name, _LOOKS[c][1]
    if 0xD800 <= cp <= 0xDFFF:
        return "control", "Unpaired surrogate", None
    if 0xFF01 <= cp <= 0xFF5E:
        like = chr(cp - 0xFEE0)
        return "confusable-letter" if like.isalpha() else "confusable-punctuation", name, like
    kind = unicodedata.category(c)
    if _within(cp, BIDI):
        return "bidi", name, None
    if _within(cp, TAGS):
        return "tag", name or "Tag character", None
    if _within(cp, VARIATION):
        return "variation-selector", name, None
    if cp & 0xFFFE == 0xFFFE or 0xFDD0 <= cp <= 0xFDEF:
        return "noncharacter", "Noncharacter", None
    if kind == "Cc":
        return "control", "Control character", None
    if kind == "Co":
        return "private-use", "Private-use character", None
    if kind == "Cf" or _within(cp, IGNORABLE):
        return "zero-width", name or "Invisible format character", None
    if kind == "Zs":
        return "unusual-space", name, None
    if kind in ("Zl", "Zp"):
        return "vertical-whitespace", name, None
    return None


def special_class() -> str:
    """A class that holds every code point ``classify`` knows; private use and noncharacters by property."""
    singles = sorted({ord(c) for c in SPACES + "".join(LISTED.values()) + "".join(_LOOKS)})
    ranges = [(cp, cp) for cp in singles] + [(0xFF01, 0xFF5E), (0, 8), (0x0E, 0x1F), (0x7F, 0x9F), *BIDI, *VARIATION, *IGNORABLE, (0xFDD0, 0xFDEF)]
    ranges += [(p * 0x10000 + 0xFFFE, p * 0x10000 + 0xFFFF) for p in range(17)]
    return java_class(ranges) + r"\p{Cf}\p{Co}\p{Zs}\p{Zl}\p{Zp}"


def dimension(spark: SparkSession) -> DataFrame:
    """``(cp, category, name, looks_like, severity, grp, label)`` of all classified code points outside private use."""
    rows = []
    for cp in [*range(0x20000), *range(0xE0000, 0xE1000)]:
        if not 0xE000 <= cp <= 0xF8FF and not 0xD800 <= cp <= 0xDFFF and (k := classify(cp)):
            rows.append((cp, *k, *CATEGORIES[k[0]]))
    return spark.createDataFrame(rows, "cp int, category string, name string, looks_like string, severity string, grp string, label string")


def fold_map(*categories: str) -> dict[str, str]:
    """What each look-alike of the categories looks like."""
    return {c: like for c, (cat, like) in _LOOKS.items() if cat in categories}
