"""Pairwise text comparison: shortest edit scripts, a plain verdict, subtle differences, unified patches.

Edit scripts are inherently sequential, so each pair is worked on in an Arrow UDF; pairs are rows and scale out as such.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import unicode as U
from ..functions.jsre import PY_WS
from ..functions.udf import arrow

WORK, ALWAYS, CHAR_GATE, SUBTLE_GATE, SIMILAR, CONTEXT = 150_000_000, 4_000, 12_000, 20_000, 0.7, 3
INVISIBLE = {"zero-width", "soft-hyphen", "bom", "bidi", "variation-selector", "tag"}
NO_EOL = "\\ No newline at end of file"
_BREAK = re.compile(r"\r\n?|\n")
_SPACES = re.compile(f"[{PY_WS}]+".replace("\\ufeff", ""))
_ANY_SPACE = re.compile(f"[{PY_WS}]+")
_WORD_CHAR = regex.compile(r"[\p{L}\p{N}\p{M}_]")


def edit_script(a: list, b: list, max_d: int | None = None) -> tuple[str, bool]:
    """A shortest script as a string of ``=``, ``-`` and ``+`` (Myers' search in linear space), and whether it was given up.

    Deletions stand before the insertions of the same place.  Where more than ``max_d`` edits are needed, all between the
    equal ends becomes deletions and insertions."""
    out: list[str] = []
    todo: list[tuple] = [(0, len(a), 0, len(b))]
    first = True
    while todo:
        job = todo.pop()
        if len(job) == 1:
            out.append("=" * job[0])
            continue
        a0, a1, b0, b1 = job
        head = 0
        while a0 + head < a1 and b0 + head < b1 and a[a0 + head] == b[b0 + head]:
            head += 1
        tail = 0
        while a0 + head < a1 - tail and b0 + head < b1 - tail and a[a1 - 1 - tail] == b[b1 - 1 - tail]:
            tail += 1
        a0, a1, b0, b1 = a0 + head, a1 - tail, b0 + head, b1 - tail
        out.append("=" * head)
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            out.append("-" * n + "+" * m + "=" * tail)
            continue
        most = n + m
        if first:
            most = max_d if max_d is not None else most if most <= ALWAYS else max(1, WORK // (most + 1))
            first = False
        met = _meeting(a[a0:a1], b[b0:b1], most)
        if met is None:
            return "=" * head + "-" * n + "+" * m + "=" * tail, True
        i, j, length = met
        todo += [(tail,), (a0 + i + length, a1, b0 + j + length, b1), (length,), (a0, a0 + i, b0, b0 + j)]
    return re.sub("[-+]+", lambda r: "-" * r[0].count("-") + "+" * r[0].count("+"), "".join(out)), False


def _meeting(x: list, y: list, most: int) -> tuple[int, int, int] | None:
    """Where a shortest path through two sequences, which differ at both ends, is half done: ``(i, j, equal run from there)``.

    One front of furthest places grows from either end by an edit at a time; a path is whole where they overlap.  Only the
    two fronts are held.  None if that takes more than ``most`` edits."""
    n, m = len(x), len(y)
    skew = n - m
    size = n + m + 3
    # furthest place in x on each diagonal, from the start and from the end; a list's last places are its negative diagonals
    ahead, back = [0] * size, [0] * size
    for d in range((n + m + 1) // 2 + 1):
        low, high = -d + 2 * max(0, d - m), d - 2 * max(0, d - n)
        for front, other, forward in ((ahead, back, True), (back, ahead, False)):
            if 2 * d - forward > most:
                return None
            for k in range(low, high + 1, 2):
                insert = k == -d or (k != d and front[k - 1] < front[k + 1])
                i = begun = front[k + 1] if insert else front[k - 1] + 1
                j = i - k
                if forward:
                    while i < n and j < m and x[i] == y[j]:
                        i, j = i + 1, j + 1
                else:
                    while i < n and j < m and x[n - 1 - i] == y[m - 1 - j]:
                        i, j = i + 1, j + 1
                front[k] = i
                facing, reached = skew - k, d - forward  # the other front's diagonal, and how far that front has come
                if (skew % 2 == 1) == forward and -reached <= facing <= reached and i + other[facing] >= n:
                    return (begun, begun - k, i - begun) if forward else (n - i, m - j, i - begun)
    return None


def lcs_length(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


# -- tokens --------------------------------------------------------------------------------------------------------------
def graphemes(text: str) -> list[str]:
    return regex.findall(r"\X", text)


def tokens(text: str, mode: str) -> list[tuple[str, str]]:
    """``(value, kind)``: graphemes; words, spaces and single marks (by a grapheme's first character); or lines."""
    if mode == "char":
        return [(g, "grapheme") for g in graphemes(text)]
    if mode == "line":
        lines = _BREAK.split(text)
        return [(x, "line") for x in (lines[:-1] if lines[-1] == "" else lines)]
    out: list[tuple[str, str]] = []
    for g in graphemes(text):
        kind = "word" if _WORD_CHAR.match(g[0]) else "space" if _ANY_SPACE.match(g[0]) else "punct"
        if out and kind != "punct" and out[-1][1] == kind:
            out[-1] = (out[-1][0] + g, kind)
        else:
            out.append((g, kind))
    return out


def lens_key(value: str, kind: str, nfc: bool = False, ignore_case: bool = False, ignore_ws: bool = False) -> str:
    """What is compared in place of a token; what is shown stays as it is."""
    if nfc:
        value = unicodedata.normalize("NFC", value)
    if ignore_case:
        value = value.lower()
    if ignore_ws and (kind == "space" or (kind == "grapheme" and not _ANY_SPACE.sub("", value))):
        value = " "
    elif ignore_ws and kind == "line":
        value = _ANY_SPACE.sub(" ", value).strip(" ")
    return value


def compare(a: str, b: str, mode: str = "word", cap: int | None = None, gate: int | None = None, **lens) -> dict:
    """Segments (runs joined except in line mode), counts, regions.  Limits are asked for: ``cap`` cuts the list of segments,
    ``gate`` (``CHAR_GATE`` is usual) refuses character mode on longer texts."""
    ta, tb = tokens(a, mode), tokens(b, mode)
    if mode == "char" and gate is not None and max(len(ta), len(tb)) > gate:
        return {"mode": mode, "segments": [], "inserted": 0, "deleted": 0, "regions": 0, "degraded": False, "capped": False, "disabled": True}
    ops, degraded = edit_script([lens_key(*t, **lens) for t in ta], [lens_key(*t, **lens) for t in tb])
    out: list[list] = []
    i = j = 0
    for op in ops:
        value = tb[j][0] if op == "+" else ta[i][0]
        i, j = i + (op != "+"), j + (op != "-")
        if out and out[-1][0] == op and mode != "line":
            out[-1][1] += value
        else:
            out.append([op, value])
    return {"mode": mode, "segments": out[:cap], "inserted": ops.count("+"), "deleted": ops.count("-"), "regions": len(re.findall("[-+]+", ops)), "degraded": degraded, "capped": cap is not None and len(out) > cap, "disabled": False}


# -- folds and verdict ---------------------------------------------------------------------------------------------------
_HOMOGLYPHS, _MARKS = (str.maketrans(U.fold_map(*c)) for c in (("confusable-letter",), ("confusable-quote", "confusable-dash", "confusable-punctuation")))
_WIDE_LETTERS = {cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F) if chr(cp - 0xFEE0).isalpha()}
_WIDE_MARKS = {cp: chr(cp - 0xFEE0) for cp in range(0xFF01, 0xFF5F) if not chr(cp - 0xFEE0).isalpha() and cp not in _MARKS}


def line_ends(s: str) -> str:
    return _BREAK.sub("\n", s)


def no_invisibles(s: str) -> str:
    return s if s.isascii() else "".join(c for c in s if not ((k := U.classify(ord(c))) and k[0] in INVISIBLE))


def one_space(s: str) -> str:
    s = _SPACES.sub(" ", line_ends(s))
    return s[s.startswith(" ") : len(s) - (len(s) > 1 and s.endswith(" "))]


FOLDS = {
    "invisibles": no_invisibles,
    "whitespace": one_space,
    "case": str.lower,
    "nfc": lambda s: unicodedata.normalize("NFC", s),
    "homoglyph": lambda s: s.translate(_HOMOGLYPHS | _WIDE_LETTERS),
    "punctuation": lambda s: s.translate(_MARKS | _WIDE_MARKS),
}
#: Compatibility folding explains more than the verdict asks for, so it is on call and not one of the verdict's folds.
nfkc = lambda s: unicodedata.normalize("NFKC", s)
_TOGETHER = ["invisibles", "nfc", "homoglyph", "punctuation", "case", "whitespace"]


def _folded(s: str, dims: list[str]) -> str:
    for d in dims:
        s = FOLDS[d](s)
    return s


def verdict(a: str, b: str) -> tuple[str, list[str]]:
    """The least that explains how two texts differ, and for a mixture the dimensions that are each needed."""
    if a == b:
        return "identical", []
    if not a or not b:
        return "empty-vs-nonempty", []
    if line_ends(a) == line_ends(b):
        return "line-endings", []
    for name, fold in FOLDS.items():
        if fold(a) == fold(b):
            return name, []
    if _folded(a, _TOGETHER) == _folded(b, _TOGETHER):
        without = lambda d: [x for x in _TOGETHER if x != d]
        return "cosmetic", [d for d in _TOGETHER if _folded(a, without(d)) != _folded(b, without(d))]
    return "different", []


def verdict_native(a: Column, b: Column) -> Column:
    """The verdict by expressions alone, for the dimensions that Spark SQL can fold; ``different`` otherwise."""
    ends = lambda c: F.regexp_replace(c, r"\r\n?", "\n")
    spaces = lambda c: F.regexp_replace(F.regexp_replace(ends(c), r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "), "^ | $", "")
    return F.when(a == b, "identical").when((a == "") | (b == ""), "empty-vs-nonempty").when(ends(a) == ends(b), "line-endings").when(spaces(a) == spaces(b), "whitespace").when(F.lower(a) == F.lower(b), "case").when(F.lower(spaces(a)) == F.lower(spaces(b)), "cosmetic").otherwise("different")


# -- subtle differences --------------------------------------------------------------------------------------------------
def subtle(a: str, b: str, gate: int | None = None) -> list[tuple[str, str, int]]:
    """``(dimension, severity, count)`` of replaced, inserted or deleted graphemes that are easily overlooked.

    Nothing is said of texts that simply differ (less than 70 % equal), or, with ``gate``, of longer ones."""
    if a == b:
        return []
    ga, gb = graphemes(a), graphemes(b)
    if gate is not None and max(len(ga), len(gb)) > gate:
        return []
    ops, _ = edit_script(ga, gb)
    if verdict(a, b)[0] == "different" and ops.count("=") / max(len(ga), len(gb), 1) < SIMILAR:
        return []
    found: dict[str, int] = {}
    i = j = 0
    for m in re.finditer("=+|[-+]+", ops):
        dels, ins = m[0].count("-"), m[0].count("+")
        if m[0][0] == "=":
            i, j = i + len(m[0]), j + len(m[0])
            continue
        gone, new = ga[i : i + dels], gb[j : j + ins]
        i, j = i + dels, j + ins
        pairs = list(zip(gone, new, strict=False)) + [(x, "") for x in gone[len(new) :]] + [("", x) for x in new[len(gone) :]]
        for p, q in pairs:
            if _BREAK.fullmatch(p or "\n") and _BREAK.fullmatch(q or "\n"):
                continue  # told by the line endings
            kind = next((d for d, f in FOLDS.items() if f(p) == f(q)), None)
            if kind is None and not (p + q).strip() and p + q:
                kind = "whitespace"
            if kind:
                found[kind] = found.get(kind, 0) + 1
    styles = [set(_BREAK.findall(s)) for s in (a, b)]
    if all(styles) and styles[0] != styles[1]:
        found["line-endings"] = sum(len(_BREAK.findall(s)) for s in (a, b))
    tier = {"invisibles": "warning", "homoglyph": "warning", "nfc": "notice", "punctuation": "notice", "whitespace": "notice"}
    out = [(d, tier.get(d, "info"), n) for d, n in found.items()]
    return sorted(out, key=lambda x: (("warning", "notice", "info").index(x[1]), -x[2], x[0]))


# -- patches -------------------------------------------------------------------------------------------------------------
def unified(a: str, b: str, **lens) -> str:
    """A unified diff with three lines of context; hunks whose contexts meet are one.

    The script is cut into runs of changes; a line that the text ends on without a line end is unlike the same line with one."""
    sides = []
    for text in (a, b):
        lines = [value for value, _ in tokens(text, "line")]
        open_end = bool(lines) and text[-1] not in "\r\n"
        keys = [(lens_key(x, "line", **lens), False) for x in lines]
        if open_end:
            keys[-1] = (keys[-1][0], True)
            lines[-1] += "\n" + NO_EOL
        sides.append((lines, keys))
    (old, old_keys), (new, new_keys) = sides
    ops, _ = edit_script(old_keys, new_keys)
    groups: list[tuple[int, int]] = []
    for run in re.finditer("[-+]+", ops):
        if groups and run.start() - groups[-1][1] <= 2 * CONTEXT:
            groups[-1] = (groups[-1][0], run.end())
        else:
            groups.append(run.span())
    out = []
    for start, end in groups:
        start, end = max(0, start - CONTEXT), min(len(ops), end + CONTEXT)
        i, j, part = start - ops.count("+", 0, start), start - ops.count("-", 0, start), ops[start:end]
        n_old, n_new = len(part) - part.count("+"), len(part) - part.count("-")
        out.append(f"@@ -{i + bool(n_old)},{n_old} +{j + bool(n_new)},{n_new} @@")
        old_lines, new_lines = iter(old[i : i + n_old]), iter(new[j : j + n_new])
        for op in part:
            if op == "=":
                next(new_lines)
                out.append(" " + next(old_lines))
            else:
                out.append(op + next(new_lines if op == "+" else old_lines))
    return "\n".join(["--- A", "+++ B", *out]) + "\n" if out else ""


# -- columns -------------------------------------------------------------------------------------------------------------
@arrow("kind string, dimensions array<string>")
def verdict_column(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([verdict(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["kind", "dimensions"])


def diff_column(a: Column, b: Column, mode: str = "word", **lens) -> Column:
    @arrow("mode string, segments array<struct<op:string,value:string>>, inserted int, deleted int, regions int, degraded boolean, capped boolean, disabled boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [compare(x or "", y or "", mode, **lens) for x, y in zip(a, b, strict=True)]
        for r in rows:
            r["segments"] = [{"op": op, "value": v} for op, v in r["segments"]]
        return pd.DataFrame(rows, columns=["mode", "segments", "inserted", "deleted", "regions", "degraded", "capped", "disabled"])

    return run(a, b)


@arrow("array<struct<dimension:string,severity:string,n:int>>")
def subtle_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"dimension": d, "severity": s, "n": n} for d, s, n in subtle(x or "", y or "")] for x, y in zip(a, b, strict=True)])


@arrow("string")
def unified_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified(x or "", y or "") for x, y in zip(a, b, strict=True)])


def side_stats(text: Column) -> Column:
    from .inspect import graphemes as count
    from .inspect import line_endings

    return F.struct(F.length(text).cast("long").alias("code_points"), count(text).alias("graphemes"), F.regexp_count(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'’_-]*")).cast("long").alias("words"), F.octet_length(text).cast("long").alias("bytes"), line_endings(text).alias("endings"), text.rlike(r"(\r\n|\r|\n)\z").alias("final_newline"))


def summary(a: str, b: str) -> str:
    """A short report on a pair."""
    kind, dims = verdict(a, b)
    d = compare(a, b, "line")
    more = "".join(f"\n- {x}: {n} ({s})" for x, s, n in subtle(a, b))
    return f"Verdict: {kind}{' (' + ', '.join(dims) + ')' if dims else ''}\nLines: +{d['inserted']} -{d['deleted']} in {d['regions']} places{more}\n"


def places(text: str, offsets: list[int]) -> list[tuple[int, int]]:
    """1-based line and column of each offset (in ascending order), in one pass."""
    out, line, start, ends = [], 1, 0, _BREAK.finditer(text)
    end = next(ends, None)
    for at in offsets:
        while end is not None and end.end() <= at:
            line, start, end = line + 1, end.end(), next(ends, None)
        out.append((line, at - start + 1))
    return out


def pair_record(a: Column, b: Column, mode: str = "word", **lens) -> Column:
    """Everything on a pair: verdict, counts and segments, subtle differences, statistics of both sides."""
    return F.struct(verdict_column(a, b).alias("verdict"), diff_column(a, b, mode, **lens).alias("diff"), subtle_column(a, b).alias("subtle"), side_stats(a).alias("a"), side_stats(b).alias("b"))
