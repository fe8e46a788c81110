"""ECMAScript-style patterns over text columns: parse, explain, lint, match with captures and places, replace, test.

A pattern is parsed once on the driver and rewritten for the engine that runs it: the ``regex`` module, which can be stopped
by a time limit, for anything that needs places or captures; Java expressions for counts and tests.  Set operations (flag
``v``) are refused as unsupported rather than guessed at.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsre import PY_WS
from ..functions.udf import arrow

FLAGS = {"d": "indices", "g": "global", "i": "ignore case", "m": "multiline", "s": "dot matches line ends", "u": "unicode", "v": "unicode sets", "y": "sticky"}
CAP, TIMEOUT, MAX_NODES = 1000, 1.5, 4000
_EOL = "\\n\\r\\u2028\\u2029"
_CONTROL = {"t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r"}


class PatternError(ValueError):
    pass


class Unsupported(PatternError):
    pass


@dataclass
class Node:
    kind: str
    start: int
    end: int = 0
    children: list["Node"] = field(default_factory=list)
    value: str = ""
    number: int | None = None
    name: str | None = None
    low: int = 1
    high: float = 1
    lazy: bool = False


def flags_of(flags: str) -> str:
    """Flags in their usual order, each once; raises on unknown ones and on u beside v."""
    if unknown := set(flags) - set(FLAGS):
        raise PatternError(f"unknown flags: {''.join(sorted(unknown))}")
    if len(set(flags)) < len(flags):
        raise PatternError("a flag is repeated")
    if "u" in flags and "v" in flags:
        raise PatternError("flags u and v exclude each other")
    return "".join(sorted(flags))


def toggle_flag(flags: str, flag: str) -> str:
    out = set(flags) ^ {flag}
    if flag in "uv" and flag in out:
        out -= {"v" if flag == "u" else "u"}
    return "".join(sorted(out))


class _Parser:
    def __init__(self, source: str, flags: str) -> None:
        self.s, self.i, self.unicode = source, 0, "u" in flags
        self.groups: list[Node] = []
        self.refs: list[Node] = []

    def fail(self, why: str):
        raise PatternError(f"{why} at {self.i}")

    def peek(self, text: str) -> bool:
        return self.s.startswith(text, self.i)

    def eat(self, text: str) -> bool:
        if self.peek(text):
            self.i += len(text)
            return True
        return False

    def pattern(self) -> Node:
        out = self.alternatives()
        if self.i < len(self.s):
            self.fail("unmatched )")
        names = {g.name for g in self.groups if g.name}
        for r in self.refs:
            if r.name is not None and r.name not in names:
                raise PatternError(f"no group is named {r.name}")
            if r.number is not None and r.number > len(self.groups):
                raise PatternError(f"there is no group {r.number}")
        return out

    def alternatives(self) -> Node:
        node = Node("alternatives", self.i)
        while True:
            branch = Node("sequence", self.i)
            while self.i < len(self.s) and self.s[self.i] not in "|)":
                branch.children.append(self.term())
            branch.end = self.i
            node.children.append(branch)
            if not self.eat("|"):
                node.end = self.i
                return node

    def term(self) -> Node:
        at = self.i
        atom = self.atom()
        m = regex.compile(r"([*+?])|\{([0-9]+)(?:(,)([0-9]*))?\}").match(self.s, self.i)
        if not m:
            if self.unicode and self.peek("{"):
                self.fail("a brace that is no quantifier")
            return atom
        if atom.kind in ("start", "end", "edge", "not-edge", "behind", "not-behind"):
            self.fail("nothing to repeat")
        self.i = m.end()
        low, high = {"*": (0, float("inf")), "+": (1, float("inf")), "?": (0, 1)}.get(m[1] or "", (0, 0)) if m[1] else (int(m[2]), (float("inf") if not m[4] else int(m[4])) if m[3] else int(m[2]))
        if low > high:
            self.fail("numbers out of order in a quantifier")
        return Node("repeat", at, children=[atom], low=low, high=high, lazy=self.eat("?"), end=self.i)

    def atom(self) -> Node:
        at, c = self.i, self.s[self.i]
        if c in "*+?":
            self.fail("nothing to repeat")
        if c == "(":
            return self.group()
        if c == "[":
            return self.charclass()
        if c == "\\":
            return self.escape()
        self.i += 1
        kind = {".": "dot", "^": "start", "$": "end"}.get(c, "char")
        if kind == "char" and self.unicode and c in "]{}":
            self.fail("a lone bracket")
        return Node(kind, at, self.i, value=c)

    def group(self) -> Node:
        at = self.i
        self.i += 1
        for text, kind in (("?:", "group"), ("?=", "ahead"), ("?!", "not-ahead"), ("?<=", "behind"), ("?<!", "not-behind")):
            if self.eat(text):
                node = Node(kind, at)
                break
        else:
            node = Node("capture", at)
            if self.peek("?"):
                m = regex.compile(r"\?<([\p{L}_$][\p{L}\p{N}_$]*)>").match(self.s, self.i)
                if not m:
                    self.fail("invalid group")
                node.name, self.i = m[1], m.end()
                if any(g.name == node.name for g in self.groups):
                    self.fail("a group name is repeated")
            self.groups.append(node)
            node.number = len(self.groups)
        node.children = [self.alternatives()]
        if not self.eat(")"):
            self.fail("a group is not ended")
        node.end = self.i
        return node

    def escape(self, inside: bool = False) -> Node:
        at = self.i
        self.i += 1
        if self.i >= len(self.s):
            self.fail("a backslash at the end")
        c = self.s[self.i]
        self.i += 1

        def char(value: str) -> Node:
            return Node("char", at, self.i, value=value)

        if c in "dDwWsS":
            return Node("set", at, self.i, value=c)
        if c in "bB" and not (inside and c == "b"):
            return Node("edge" if c == "b" else "not-edge", at, self.i)
        if inside and c == "b":
            return char("\b")
        if c in _CONTROL:
            return char(_CONTROL[c])
        if c == "0" and not (self.i < len(self.s) and self.s[self.i].isdigit()):
            return char("\0")
        if c == "c" and self.i < len(self.s) and self.s[self.i].isascii() and self.s[self.i].isalpha():
            self.i += 1
            return char(chr(ord(self.s[self.i - 1]) % 32))
        if c == "x" and (m := regex.compile("[0-9A-Fa-f]{2}").match(self.s, self.i)):
            self.i = m.end()
            return char(chr(int(m[0], 16)))
        if c == "u":
            if self.unicode and (m := regex.compile(r"\{([0-9A-Fa-f]{1,6})\}").match(self.s, self.i)):
                self.i = m.end()
                return char(chr(int(m[1], 16)))
            if m := regex.compile("[0-9A-Fa-f]{4}").match(self.s, self.i):
                self.i = m.end()
                high = int(m[0], 16)
                pair = regex.compile(r"\\u([dD][c-fC-F][0-9A-Fa-f]{2})").match(self.s, self.i)
                if 0xD800 <= high < 0xDC00 and pair:
                    self.i = pair.end()
                    return char(chr(0x10000 + (high - 0xD800) * 0x400 + int(pair[1], 16) - 0xDC00))
                return char(chr(high))
        if c in "pP" and self.unicode:
            m = regex.compile(r"\{([A-Za-z0-9_=]+)\}").match(self.s, self.i)
            if not m:
                self.fail("invalid property")
            self.i = m.end()
            return Node("property", at, self.i, value=f"\\{c}{{{m[1]}}}")
        if not inside and c == "k" and (m := regex.compile("<([^>]+)>").match(self.s, self.i)):
            self.i = m.end()
            self.refs.append(Node("backref", at, self.i, name=m[1]))
            return self.refs[-1]
        if not inside and c in "123456789":
            m = regex.compile("[0-9]*").match(self.s, self.i)
            self.i = m.end()
            self.refs.append(Node("backref", at, self.i, number=int(c + m[0])))
            return self.refs[-1]
        if self.unicode and c not in "^$\\.*+?()[]{}|/-":
            self.fail("invalid escape")
        return char(c)

    def charclass(self) -> Node:
        node = Node("class", self.i)
        self.i += 1
        node.value = "^" if self.eat("^") else ""
        while not self.eat("]"):
            if self.i >= len(self.s):
                self.fail("a class is not ended")
            first = self.member()
            if self.peek("-") and self.i + 1 < len(self.s) and self.s[self.i + 1] != "]":
                self.i += 1
                last = self.member()
                if first.kind == last.kind == "char":
                    if first.value > last.value:
                        self.fail("a range is out of order")
                    node.children.append(Node("range", first.start, self.i, value=first.value + last.value))
                    continue
                if self.unicode:
                    self.fail("a range of sets")
                node.children += [first, Node("char", first.end, first.end + 1, value="-"), last]
            else:
                node.children.append(first)
        node.end = self.i
        return node

    def member(self) -> Node:
        if self.s[self.i] == "\\":
            return self.escape(inside=True)
        self.i += 1
        return Node("char", self.i - 1, self.i, value=self.s[self.i - 1])


@dataclass
class Pattern:
    source: str
    flags: str
    tree: Node
    groups: list[Node]

    @property
    def names(self) -> list[str | None]:
        return [g.name for g in self.groups]


@lru_cache(maxsize=256)
def parse(source: str, flags: str = "") -> Pattern:
    flags = flags_of(flags)
    if "v" in flags:
        raise Unsupported("flag v (set operations) is not supported")
    p = _Parser(source, flags)
    return Pattern(source, flags, p.pattern(), p.groups)


def parse_literal(text: str) -> tuple[str, str] | None:
    """``/body/flags`` as its parts, or None."""
    m = regex.fullmatch(r"/((?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+)/([a-z]*)", text.strip())
    return (m[1], m[2]) if m else None


def literal(source: str, flags: str = "") -> str:
    """The pattern as a literal: slashes and line ends escaped outside what is escaped already."""
    if not source:
        return f"/(?:)/{flags}"
    out = regex.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]|/|[\n\r\u2028\u2029]", lambda m: m[0] if len(m[0]) > 1 else {"/": r"\/", "\n": r"\n", "\r": r"\r", "\u2028": r"\u2028", "\u2029": r"\u2029"}[m[0]], source, flags=regex.S)
    return f"/{out}/{flags}"


def constructor(source: str, flags: str = "") -> str:
    import json

    return f"new RegExp({json.dumps(source, ensure_ascii=False)}" + (f', "{flags}")' if flags else ")")


# -- rewriting -----------------------------------------------------------------------------------------------------------
_SETS = {"d": "0-9", "w": "A-Za-z0-9_", "s": PY_WS.replace("-\\r ", "-\\r\\x20")}


def rewrite(p: Pattern, java: bool = False) -> str:
    """The pattern in the syntax of Python's ``regex`` module, or of Java."""
    multi, dotall = "m" in p.flags, "s" in p.flags
    top = "\\x{10FFFF}" if java else "\\U0010ffff"
    # what a set leaves out, as ranges, since a negated set may stand inside a class
    complement = {"d": f"\\x00-/:-{top}", "w": f"\\x00-/:-@\\[-\\^`\\{{-{top}", "s": f"\\x00-\\x08\\x0e-\\x1f!-\\x9f\\u00a1-\\u167f\\u1681-\\u1fff\\u200b-\\u2027\\u202a-\\u202e\\u2030-\\u205e\\u2060-\\u2fff\\u3001-\\ufefe\\uff00-{top}"}
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

    def lit(c: str) -> str:
        if c.isalnum() and c.isascii() or ord(c) > 127 and c.isprintable():
            return c
        return (f"\\x{{{ord(c):X}}}" if java else f"\\U{ord(c):08x}") if ord(c) < 32 or ord(c) > 126 else "\\" + c

    def member(n: Node) -> str:
        if n.kind == "range":
            return f"{lit(n.value[0])}-{lit(n.value[1])}"
        if n.kind == "property":
            return n.value
        if n.kind == "set":
            if n.value.islower():
                return _SETS[n.value]
            return complement[n.value.lower()]
        return lit(n.value)

    def go(n: Node) -> str:
        k = n.kind
        if k == "alternatives":
            return "|".join(go(c) for c in n.children)
        if k == "sequence":
            return "".join(go(c) for c in n.children)
        if k == "char":
            return lit(n.value)
        if k == "dot":
            return "(?s:.)" if dotall else f"[^{_EOL}]"
        if k == "start":
            return f"(?:\\A|(?<=[{_EOL}]))" if multi else "\\A"
        if k == "end":
            return (f"(?:(?=[{_EOL}])|\\z)" if multi else "\\z") if java else (f"(?:(?=[{_EOL}])|\\Z)" if multi else "\\Z")
        if k == "edge":
            return edge
        if k == "not-edge":
            return f"(?!{edge})"
        if k == "set":
            return f"[{'' if n.value.islower() else '^'}{_SETS[n.value.lower()]}]"
        if k == "property":
            return n.value
        if k == "class":
            if not n.children:
                return "(?s:.)" if n.value else "(?!)"
            return f"[{n.value}{''.join(member(c) for c in n.children)}]"
        if k == "repeat":
            high = "" if n.high == float("inf") else int(n.high)
            mark = {(0, ""): "*", (1, ""): "+", (0, 1): "?"}.get((n.low, high), f"{{{n.low}}}" if n.low == high else f"{{{n.low},{high}}}")
            return f"(?:{go(n.children[0])}){mark}" + "?" * n.lazy
        if k == "backref":
            ref = n.number if n.number is not None else next(i for i, g in enumerate(p.groups, 1) if g.name == n.name)
            return f"\\{ref}" if java else f"(?({ref})(?:\\{ref})|)"  # a group that took no part matches nothing
        body = go(n.children[0])
        return {"group": "(?:", "ahead": "(?=", "not-ahead": "(?!", "behind": "(?<=", "not-behind": "(?<!", "capture": "("}[k] + body + ")"

    flags = "i" if "i" in p.flags else ""
    return f"(?{flags}{'u' if java and flags else ''})" * bool(flags) + go(p.tree)


@lru_cache(maxsize=256)
def compiled(source: str, flags: str = ""):
    p = parse(source, flags)
    try:
        return p, regex.compile(rewrite(p), regex.V0)
    except regex.error as e:
        raise PatternError(str(e)) from e


# -- analysis ------------------------------------------------------------------------------------------------------------
def can_be_empty(n: Node) -> bool:
    k = n.kind
    if k == "alternatives":
        return any(can_be_empty(c) for c in n.children)
    if k == "sequence":
        return all(can_be_empty(c) for c in n.children)
    if k in ("capture", "group"):
        return can_be_empty(n.children[0])
    if k == "repeat":
        return n.low == 0 or can_be_empty(n.children[0])
    return k not in ("char", "dot", "set", "class", "property", "range")


def _walk(n: Node):
    yield n
    for c in n.children:
        yield from _walk(c)


def lints(source: str, flags: str = "") -> list[tuple[str, str, str]]:
    """``(id, severity, what)``, worst first."""
    p = parse(source, flags)
    out = []
    varies = lambda n: n.kind == "repeat" and (n.high == float("inf") or n.low == 0)
    for n in _walk(p.tree):
        if n.kind == "repeat" and n.high == float("inf") and any(varies(x) for c in n.children for x in _walk(c)):
            out.append(("nested-quantifier", "warning", source[n.start : n.end]))
            break
    if can_be_empty(p.tree):
        out.append(("global-zero-width", "notice", "matches between characters") if set(p.flags) & {"g", "y"} else ("can-match-empty", "info", "matches nothing at all"))
    return out


def explain(source: str, flags: str = "") -> list[tuple[int, int, str, str]]:
    """``(depth, start, kind, what)`` of each part of the pattern, in order; at most 4,000 parts."""
    says = {"alternatives": "one of", "sequence": "in this order", "dot": "any character", "start": "the start", "end": "the end", "edge": "a word's edge", "not-edge": "no word's edge", "ahead": "followed by", "not-ahead": "not followed by", "behind": "after", "not-behind": "not after", "group": "a group", "class": "one of these characters", "backref": "what a group matched", "property": "a character with a property", "set": "a character of a set", "range": "from, to"}
    out: list[tuple[int, int, str, str]] = []

    def go(n: Node, depth: int) -> None:
        if len(out) >= MAX_NODES:
            return
        single = n.kind in ("alternatives", "sequence") and len(n.children) == 1
        if not single:
            what = says.get(n.kind, "")
            if n.kind == "repeat":
                what = f"{n.low} to {'any number of' if n.high == float('inf') else int(n.high)} times, {'as few' if n.lazy else 'as many'} as possible"
            elif n.kind == "capture":
                what = f"group {n.number}" + (f" ({n.name})" if n.name else "")
            elif n.kind == "class" and n.value:
                what = "none of these characters"
            out.append((depth, n.start, n.kind, f"{what or 'literally'}: {source[n.start:n.end]}"))
        for c in n.children:
            go(c, depth + (not single))

    go(parse(source, flags).tree, 0)
    return out


# -- running -------------------------------------------------------------------------------------------------------------
def run(source: str, flags: str, text: str, cap: int | None = None, timeout: float = TIMEOUT) -> tuple[list, bool]:
    """``(matches, truncated)``; with g all matches, else the first; with y only from where the last one ended.

    An empty match moves on by one code point.  ``truncated`` only if a further match exists.  TimeoutError after ``timeout``."""
    p, r = compiled(source, flags)
    step = r.match if "y" in p.flags else r.search
    many = "g" in p.flags
    out, at = [], 0
    while at <= len(text):
        m = step(text, at, timeout=timeout)
        if m is None:
            break
        if cap is not None and len(out) >= cap:
            return out, True
        out.append(m)
        if not many:
            break
        at = m.end() + (m.end() == m.start())
    return out, False


_GROUPS = pa.list_(pa.struct([("number", pa.int32()), ("name", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_ROWS = "id long, status string, ordinal int, start int, end int, value string, line int, column int, groups array<struct<number:int,name:string,value:string,start:int,end:int>>"


def matches(df: DataFrame, id_col: str, text_col: str, source: str, flags: str = "g", cap: int | None = None, timeout: float = TIMEOUT) -> DataFrame:
    """One row per match; a text without one gives none.  A text that took too long gives one row with status ``timeout``,
    one with more than ``cap`` matches (none by default; the reference stops at ``CAP``) a last row with status ``truncated``.  A group that took no part is null, an empty one is ''."""
    p, _ = compiled(source, flags)  # errors show here, on the driver
    names = p.names

    def each(batches):
        cols = [x.split()[0] for x in _ROWS.split("array")[0].split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), _GROUPS]
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t is None:
                    continue
                try:
                    found, more = run(source, flags, t, cap, timeout)
                except TimeoutError:
                    rows.append((d, "timeout", *[None] * 7))
                    continue
                line, seen = 1, 0
                for k, m in enumerate(found):
                    ends = list(regex.finditer(r"\r\n|\r|\n", t, pos=seen, endpos=m.start()))
                    line, seen = line + len(ends), ends[-1].end() if ends else seen
                    g = [{"number": i, "name": names[i - 1], "value": m[i], "start": m.start(i) if m[i] is not None else None, "end": m.end(i) if m[i] is not None else None} for i in range(1, len(names) + 1)]
                    rows.append((d, "match", k, *m.span(), m[0], line, m.start() - seen + 1, g))
                if more:
                    rows.append((d, "truncated", *[None] * 7))
            part = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], cols)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(each, _ROWS)


def _native(source: str, flags: str) -> str | None:
    """The pattern for Java, or None where it has back-references: Java fails one whose group took no part, where ECMAScript
    matches nothing, and reads a digit behind it as part of its number."""
    p = parse(source, flags)
    return None if any(n.kind == "backref" for n in _walk(p.tree)) else rewrite(p, java=True)


def _counted(source: str, flags: str, first: bool):
    every = "".join(c for c in parse(source, flags).flags if c not in "gy") + ("" if first else "g")

    @arrow("int")
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else len(run(source, every, t)[0])).astype("Int32")

    return each


def count(text: Column, source: str, flags: str = "") -> Column:
    """How many matches: natively, but for patterns with back-references."""
    native = _native(source, flags)
    return F.regexp_count(text, F.lit(native)) if native is not None else _counted(source, flags, False)(text)


def test(text: Column, source: str, flags: str = "") -> Column:
    """Whether the pattern is found, natively but for patterns with back-references; g and y do not matter."""
    native = _native(source, flags)
    return text.rlike(native) if native is not None else _counted(source, flags, True)(text) > 0


def replacement_parts(replacement: str, groups: int, names: list[str | None]) -> list[tuple[str, str]]:
    """``(text, kind)`` of a replacement: text, dollar, match, prefix, suffix, group, named, unknown-group, unknown-named."""
    named = {n for n in names if n}
    token = regex.compile(r"\$(?:(\$)|(&)|(`)|(')|<([^>]*)>|([0-9]{2})|([0-9]))" if named else r"\$(?:(\$)|(&)|(`)|(')|(?!)()|([0-9]{2})|([0-9]))")
    out, at, i = [], 0, 0
    while m := token.search(replacement, i):
        text, kind, end = m[0], None, m.end()
        if m[5] is not None and named:
            kind = "named" if m[5] in named else "unknown-named"
        elif m[6] or m[7]:
            two, one = int(m[6] or -1), int((m[6] or m[7])[0])
            if 1 <= two <= groups:
                kind = "group"
            else:
                kind, text = "group" if 1 <= one <= groups else "unknown-group", m[0][:2]
                end = m.start() + 2
        else:
            kind = "dollar" if m[1] else "match" if m[2] else "prefix" if m[3] else "suffix"
        if m.start() > at:
            out.append((replacement[at : m.start()], "text"))
        out.append((text, kind))
        at = i = end
    if at < len(replacement):
        out.append((replacement[at:], "text"))
    return out


def replace_text(source: str, flags: str, text: str, replacement: str) -> tuple[str, int]:
    p, _ = compiled(source, flags)
    parts = replacement_parts(replacement, len(p.groups), p.names)
    found, _ = run(source, flags, text, cap=1 << 60)
    out, at = [], 0
    for m in found:
        out.append(text[at : m.start()])
        for raw, kind in parts:
            if kind == "group":
                out.append(m[int(raw[1:])] or "")
            elif kind == "named":
                out.append(m[p.names.index(raw[2:-1]) + 1] or "")
            else:
                out.append({"text": raw, "unknown-group": raw, "dollar": "$", "match": m[0], "prefix": text[: m.start()], "suffix": text[m.end() :], "unknown-named": ""}[kind])
        at = m.end()
    return "".join([*out, text[at:]]), len(found)


def replace(text: Column, source: str, flags: str, replacement: str) -> Column:
    """``struct(value, n)``; all matches with g, else the first.  Too slow a text: null."""
    compiled(source, flags)

    @arrow("value string, n int")
    def each(s: pd.Series) -> pd.DataFrame:
        out = []
        for t in s:
            try:
                out.append((None, None) if t is None else replace_text(source, flags, t, replacement))
            except TimeoutError:
                out.append((None, None))
        return pd.DataFrame(out, columns=["value", "n"], dtype=object)

    return each(text)


def bench(cases: list[str], source: str, flags: str = "", most: int | None = None, longest: int | None = None) -> list[bool]:
    """Whether each of a few texts matches anywhere; ``most`` and ``longest`` cut the list and the texts where asked for."""
    plain = "".join(c for c in parse(source, flags).flags if c not in "gy")
    return [bool(run(source, plain, t[:longest])[0]) for t in cases[:most]]


def highlight(text: str, source: str, flags: str = "g", cap: int | None = None) -> list[tuple[str, bool]]:
    """The text as runs, matched or not; an empty match is an empty run."""
    out, at = [], 0
    for m in run(source, flags, text, cap)[0]:
        if m.start() > at:
            out.append((text[at : m.start()], False))
        out.append((m[0], True))
        at = m.end()
    return out + ([(text[at:], False)] if at < len(text) else [])


def summary(source: str, flags: str = "") -> str:
    p = parse(source, flags)
    rows = [f"Pattern: {literal(source, p.flags)}", f"Groups: {len(p.groups)}" + "".join(f", {n}" for n in p.names if n)]
    return "\n".join(rows + [f"{s}: {i} ({w})" for i, s, w in lints(source, flags)])
