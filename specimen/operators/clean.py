"""Sixteen opt-in text transforms in a fixed order, each idempotent, as one chain of column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.udf import arrow

from ..functions import unicode as U
from ..functions.jsre import trim

DEFAULT_ON = ["normalize-line-endings", "strip-trailing-whitespace"]
_CONTROLS = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]"
_TRAILING = r"[ \t]+(?=\r\n|\r|\n|\z)"
_ZERO = r"[\x{200B}\x{2060}-\x{2064}\x{180E}]"


@arrow("string")
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


@arrow("long")
def nfc_changes(s: pd.Series) -> pd.Series:
    def count(x):
        if x is None:
            return None
        y = unicodedata.normalize("NFC", x)
        if y == x:
            return 0
        return len(x) - len(y) if len(x) > len(y) else sum(unicodedata.normalize("NFC", c) != c for c in x) or max(1, len(y) - len(x))

    return s.map(count)


def _drop(cls: str):
    return lambda c: F.regexp_replace(c, cls, ""), lambda c: F.regexp_count(c, F.lit(cls))


def _swap(chars: str, to: str):
    return lambda c: F.translate(c, chars, to * len(chars)), lambda c: F.regexp_count(c, F.lit(f"[{U.java_class(chars)}]"))


def _zero_width(c: Column) -> Column:
    return F.when(c.startswith("﻿"), F.concat(F.lit("﻿"), F.regexp_replace(F.translate(c, "﻿", ""), _ZERO, ""))).otherwise(F.regexp_replace(F.translate(c, "﻿", ""), _ZERO, ""))


_ranges = lambda r: f"[{U.java_class(r)}]"
#: In the order in which they apply: name -> (transform, count of what it would change).
TRANSFORMS = {
    "strip-bom": (lambda c: F.regexp_replace(c, r"\A\x{FEFF}", ""), lambda c: c.startswith("﻿").cast("int")),
    "normalize-line-endings": (lambda c: F.regexp_replace(c, r"\r\n?", "\n"), lambda c: F.regexp_count(c, F.lit(r"\r"))),
    "nfc-normalize": (nfc, nfc_changes),
    "normalize-nbsp": _swap(U.NBSP, " "),
    "normalize-unicode-spaces": _swap("".join(c for c in U.SPACES if c not in U.NBSP), " "),
    "smart-quotes": (lambda c: F.translate(c, "".join(U.CLEAN_QUOTES), "".join(U.CLEAN_QUOTES.values())), lambda c: F.regexp_count(c, F.lit("[‘’“”]"))),
    "dashes-to-hyphen": _swap(U.CLEAN_DASHES, "-"),
    "remove-zero-width": (_zero_width, lambda c: F.regexp_count(c, F.lit(_ZERO)) + F.regexp_count(c, F.lit(r"\x{FEFF}")) - c.startswith("﻿").cast("int")),
    "remove-zwj-zwnj": _drop(r"[\x{200C}\x{200D}]"),
    "remove-controls": _drop(_CONTROLS),
    "remove-bidi": _drop(_ranges(U.BIDI)),
    "remove-variation-selectors": _drop(_ranges(U.VARIATION)),
    "remove-tags": _drop(_ranges(U.TAGS)),
    "remove-soft-hyphens": _drop(r"\x{AD}"),
    "strip-trailing-whitespace": (lambda c: F.regexp_replace(c, _TRAILING, ""), lambda c: F.length(c) - F.length(F.regexp_replace(c, _TRAILING, ""))),
    "trim-document-edges": (trim, lambda c: F.length(c) - F.length(trim(c))),
}


def apply(text: Column, enabled: list[str] | None = None) -> Column:
    """The text after the enabled transforms, in pipeline order whatever the order of the list."""
    chosen = set(DEFAULT_ON if enabled is None else enabled)
    if unknown := chosen - set(TRANSFORMS):
        raise ValueError(f"unknown transforms: {sorted(unknown)}")
    for name, (change, _) in TRANSFORMS.items():
        if name in chosen:
            text = change(text)
    return text


def counts(text: Column) -> Column:
    """A struct of what each transform would change in the text as it is."""
    return F.struct(*[count(text).cast("long").alias(name.replace("-", "_")) for name, (_, count) in TRANSFORMS.items()])
