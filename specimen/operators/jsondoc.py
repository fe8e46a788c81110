"""JSON documents as node tables: one row per value, with its pointer, source text and place.

The scanner is strict (RFC 8259), iterative and keeps what parsers drop: repeated keys, raw digits, offsets.  Everything
above the node table (structure, shapes, field types, nullability, findings, search) is native grouping.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unicode as U
from ..functions.jsre import py_trim, trim
from ..functions.udf import arrow
from .findings import SCHEMA, TIER, finding, gather

_WS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
_WORDS = {"true": "boolean", "false": "boolean", "null": "null"}
MAX_SAFE = 2**53 - 1
DEPTH, LONG_ARRAY, WIDE_OBJECT, LONG_STRING, MANY_EMPTY = 16, 1000, 100, 8192, 3


class JsonError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


def token(key: str) -> str:
    """A key as a JSON Pointer token (RFC 6901)."""
    return key.replace("~", "~0").replace("/", "~1")


def untoken(part: str) -> str:
    return part.replace("~1", "/").replace("~0", "~")


def pointer(path: list) -> str:
    return "".join(f"/{token(str(p))}" for p in path)


def from_pointer(text: str) -> list[str]:
    if text == "":
        return []
    if not text.startswith("/"):
        raise ValueError("a JSON Pointer is empty or begins with /")
    return [untoken(p) for p in text[1:].split("/")]


def accessor(path: list, root: str = "$") -> str:
    """``$.a[0]["odd key"]``."""
    return root + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", p) else f"[{json.dumps(p, ensure_ascii=False)}]" for p in path)


class Node:
    __slots__ = ("pointer", "parent", "key", "idx", "depth", "kind", "raw", "value", "children", "offset", "length", "dup")

    def __init__(self, pointer, parent, key, idx, depth, kind, offset):
        self.pointer, self.parent, self.key, self.idx, self.depth, self.kind, self.offset = pointer, parent, key, idx, depth, kind, offset
        self.raw = self.value = None
        self.children, self.length, self.dup = 0, 0, False


def scan(src: str) -> list[Node]:
    """All values in document order; raises ``JsonError`` at the first fault."""
    out: list[Node] = []
    stack: list[tuple[Node, dict]] = []  # open containers, with the first node of each key
    n = len(src)
    skip = lambda i: _WS.match(src, i).end()

    def fail(i: int, wanted: str):
        got = "the end of the text" if i >= n else repr(src[i])
        raise JsonError(f"expected {wanted}, found {got}", i)

    i, want = skip(0), "value"
    while True:
        if want == "value":
            if stack:
                box, keys = stack[-1]
                key = pending if box.kind == "object" else None
                idx = box.children
                node = Node(f"{box.pointer}/{token(key) if key is not None else idx}", box.pointer, key, idx, box.depth + 1, "", i)
                box.children += 1
                if key is not None:
                    if key in keys:
                        keys[key].dup = node.dup = True
                    else:
                        keys[key] = node
            else:
                node = Node("", None, None, None, 0, "", i)
            out.append(node)
            c = src[i] if i < n else ""
            if c in "{[" and c:
                node.kind = "object" if c == "{" else "array"
                stack.append((node, {}))
                i = skip(i + 1)
                if i < n and src[i] == ("}" if c == "{" else "]"):
                    want = "close"
                else:
                    want = "key" if c == "{" else "value"
                continue
            if c == '"':
                m = _STRING.match(src, i)
                if not m:
                    fail_at = i + 1
                    while fail_at < n and src[fail_at] not in '"\\' and src[fail_at] >= " ":
                        fail_at += 1
                    raise JsonError("a string is not ended or holds a bad escape or control character", min(fail_at, n))
                node.kind, node.value = "string", json.loads(m[0])
            elif c == "-" or c.isdigit():
                m = _NUMBER.match(src, i)
                if not m:
                    fail(i + 1, "a digit")
                node.kind = "number"
            else:
                m = re.compile("true|false|null").match(src, i)
                if not m:
                    fail(i, "a value")
                node.kind = _WORDS[m[0]]
            node.raw, node.length, i = m[0], len(m[0]), m.end()
        elif want == "key":
            if i >= n or src[i] != '"':
                fail(i, "a key in double quotes")
            m = _STRING.match(src, i)
            if not m:
                raise JsonError("a key is not ended or holds a bad escape or control character", i)
            pending = json.loads(m[0])
            i = skip(m.end())
            if i >= n or src[i] != ":":
                fail(i, "':'")
            i, want = skip(i + 1), "value"
            continue
        else:
            node, _ = stack.pop()
            i += 1
            node.length = i - node.offset
        i = skip(i)
        if not stack:
            if i < n:
                fail(i, "the end of the text")
            return out
        box = stack[-1][0]
        end = "}" if box.kind == "object" else "]"
        if i < n and src[i] == end:
            want = "close"
        elif i < n and src[i] == ",":
            i = skip(i + 1)
            want = "key" if box.kind == "object" else "value"
            if i < n and src[i] == end:
                raise JsonError("a comma stands before the end", i)
        else:
            fail(i, f"',' or '{end}'")


def place(src: str, at: int) -> tuple[int, int]:
    """1-based line and column of an offset."""
    before = re.split(r"\r\n|\r|\n", src[:at])
    return len(before), len(before[-1]) + 1


def preview(value: str, cap: int = 200) -> str:
    """One line, control characters escaped, cut at ``cap``."""
    shown = "".join(c if c.isprintable() else c.encode("unicode_escape").decode() for c in value[: cap + 1])
    return shown[:cap] + "…" if len(shown) > cap or len(value) > cap else shown


_NODES = "doc_id long, ord int, pointer string, parent string, key string, idx int, depth int, kind string, raw string, value string, string_length int, child_count int, offset int, length int, is_dup_key boolean"
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]


def nodes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The node table of all documents that parse; see ``errors`` for the others."""

    def run(batches):
        names = [x.split()[0] for x in _NODES.split(", ")]
        for b in batches:
            for d, src in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = scan(src or "")
                except JsonError:
                    continue
                for lo in range(0, len(found), 10_000):
                    rows = [(d, k, x.pointer, x.parent, x.key, x.idx, x.depth, x.kind, x.raw, _utf8(x.value), None if x.value is None else len(x.value), x.children, x.offset, x.length, x.dup) for k, x in enumerate(found[lo : lo + 10_000], lo)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _NODES)


def _utf8(s: str | None) -> str | None:
    """Lone surrogates, which only escapes can make, have no UTF-8 form."""
    return None if s is None else s.encode("utf-8", "replace").decode()


@arrow("status string, message string, at int, line int, column int, context string")
def errors(s: pd.Series) -> pd.DataFrame:
    """What is wrong with each text: ``ok``, ``empty``, or ``error`` with its first fault and the text around it."""
    out = []
    for src in s:
        if not (src or "").strip():
            out.append(("empty", None, None, None, None, None))
            continue
        try:
            scan(src)
            out.append(("ok", None, None, None, None, None))
        except JsonError as e:
            out.append(("error", str(e), e.at, *place(src, e.at), preview(src[max(0, e.at - 20) : e.at + 20])))
    return pd.DataFrame(out, columns=["status", "message", "at", "line", "column", "context"], dtype=object)


def structure(n: DataFrame) -> DataFrame:
    """One row per document: values by kind, properties, depth, and the largest containers (of equals the last)."""
    count = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    top = lambda k: F.max_by("pointer", F.when(F.col("kind") == k, F.struct("child_count", "ord")))
    return n.groupBy("doc_id").agg(*[count(k) for k in ("object", "array", "string", "number", "boolean", "null")], F.count("key").alias("n_properties"), F.max("depth").alias("max_depth"), top("array").alias("largest_array"), top("object").alias("largest_object"), F.max("string_length").alias("longest_string"))


def duplicate_keys(n: DataFrame) -> DataFrame:
    return n.where("is_dup_key").groupBy("doc_id", "parent", "key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("offset")).alias("offsets"))


def _objects(n: DataFrame) -> DataFrame:
    """Objects that are elements of an array, with their array: ``(doc_id, array, object, ord)``."""
    e = n.where("kind = 'object' and parent is not null and key is null")
    many = e.groupBy("doc_id", "parent").agg(F.count(F.lit(1)).alias("k")).where("k >= 3")
    return e.join(many, ["doc_id", "parent"], "left_semi").select("doc_id", F.col("parent").alias("array"), F.col("pointer").alias("object"), "ord")


def _fields(n: DataFrame) -> DataFrame:
    """Members of those objects, of repeated keys the last: ``(doc_id, array, object, key, kind, pointer)``."""
    f = n.where("key is not null").groupBy("doc_id", F.col("parent").alias("object"), "key").agg(F.max_by("kind", "ord").alias("kind"), F.max_by("pointer", "ord").alias("pointer"))
    return f.join(_objects(n).drop("ord"), ["doc_id", "object"])


def shapes(n: DataFrame) -> DataFrame:
    """Key sets of the objects of each array of three or more: ``(doc_id, array, keys, n, rank, missing, extra)``."""
    keys = _fields(n).groupBy("doc_id", "array", "object").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    o = _objects(n).join(keys, ["doc_id", "array", "object"], "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    g = o.groupBy("doc_id", "array", "keys").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy("doc_id", "array")
    g = g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "first"))).withColumn("main", F.max(F.when(F.col("rank") == 1, F.col("keys"))).over(w)).withColumn("of", F.sum("n").over(w))
    return g.select("doc_id", "array", "keys", "n", "rank", F.array_except("main", "keys").alias("missing"), F.array_except("keys", "main").alias("extra"), (F.col("n") / F.col("of")).alias("share"))


def field_types(n: DataFrame) -> DataFrame:
    """Fields of such arrays with two or more kinds other than null: one row per kind."""
    g = _fields(n).where("kind != 'null'").groupBy("doc_id", "array", "key", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("pointer").alias("example"))
    w = Window.partitionBy("doc_id", "array", "key")
    g = g.withColumn("kinds", F.count(F.lit(1)).over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "kind")))
    return g.where("kinds > 1").drop("kinds")


def nullability(n: DataFrame) -> DataFrame:
    """Fields of such arrays: how often present, null, missing."""
    size = _objects(n).groupBy("doc_id", "array").agg(F.count(F.lit(1)).alias("objects"))
    g = _fields(n).groupBy("doc_id", "array", "key").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("kind") == "null").alias("nulls"))
    return g.join(size, ["doc_id", "array"]).select("doc_id", "array", "key", "present", "nulls", (F.col("objects") - F.col("present")).alias("missing"))


def unsafe_number(raw: Column) -> Column:
    """``unsafe-integer`` beyond 2^53 - 1, ``overflow`` to infinity, else null.  Digits are compared as text: no rounding."""
    digits = F.regexp_replace(raw, "^-?0*", "")
    big = raw.rlike("^-?[0-9]+$") & ((F.length(digits) > 16) | ((F.length(digits) == 16) & (digits > str(MAX_SAFE))))
    value = raw.try_cast("double")
    return F.when(F.abs(value) == float("inf"), "overflow").when(big, "unsafe-integer")


def search(n: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Values whose key or scalar holds the text, whatever the case, in document order; all of them unless ``limit`` is given."""
    q = F.lit(query.lower())
    hit = n.where(F.lower(F.coalesce("key", F.lit(""))).contains(q) | F.lower(F.coalesce("value", "raw", F.lit(""))).contains(q))
    hit = hit.select("doc_id", "ord", "pointer", "key", "kind", "raw").orderBy("doc_id", "ord")
    return hit.limit(limit) if limit is not None else hit


def _hidden_ranges() -> list[tuple[int, int]]:
    look = set("".join(U._LOOKS)) | set("\t")
    singles = sorted({ord(c) for c in U.SPACES + "".join(U.LISTED.values()) if c not in look})
    return [(c, c) for c in singles] + [(0, 8), (0x0E, 0x1F), (0x7F, 0x9F), *U.BIDI, *U.VARIATION, *U.IGNORABLE]


def _hidden_class() -> str:
    return "[" + U.java_class(_hidden_ranges()) + r"\p{Cf}\p{Co}]"


def hidden(text: Column) -> Column:
    """The first character of a string that cannot be seen, or is an unusual space; null if there is none."""
    return F.nullif(F.regexp_extract(text, _hidden_class(), 0), F.lit(""))


_HIDDEN = re.compile("[" + "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in _hidden_ranges()) + "]")


def has_hidden(s: str) -> bool:
    """``hidden`` for one string."""
    if s.isascii() and s.isprintable():
        return False
    return _HIDDEN.search(s) is not None or any(unicodedata.category(c) in ("Cf", "Co") for c in s if not c.isascii())


CATEGORY = {"keys": 0, "numbers": 1, "types": 2, "shape": 3, "nulls": 4, "strings": 5, "structure": 6, "size": 7, "empty": 8}


#: Rules that count values of a document: id, severity, category, title, detail, and how many it takes.
_TALLIES = [
    ("keys-whitespace", "notice", "keys", "Spaces around keys", "Lookups by the bare name miss them.", 1),
    ("keys-empty", "info", "keys", "Empty keys", "A key without a name.", 1),
    ("keys-hidden", "notice", "keys", "Keys with characters that cannot be seen", "They look like other keys and are not.", 1),
    ("numbers-unsafe", "warning", "numbers", "Numbers that double precision cannot hold", "Readers that use doubles will change them.", 1),
    ("strings-hidden", "notice", "strings", "Strings with characters that cannot be seen", "They differ from what is shown.", 1),
    ("size-array", "info", "size", "Large arrays", "Larger than is usual.", 1),
    ("size-object", "info", "size", "Large objects", "Larger than is usual.", 1),
    ("size-string", "info", "size", "Large strings", "Larger than is usual.", 1),
    ("empty-arrays", "info", "empty", "Empty arrays", "They hold nothing.", MANY_EMPTY),
    ("empty-objects", "info", "empty", "Empty objects", "They hold nothing.", MANY_EMPTY),
    ("empty-strings", "info", "empty", "Empty strings", "A large part of all strings.", 5),
]


def _tallied(n: DataFrame) -> DataFrame:
    """Rules that count values of a document, all in one aggregate: a count and the first examples of each."""
    key, kind, at = F.col("key"), F.col("kind"), "pointer"
    when = [
        ((key != "") & (key != trim(key)), at),
        (key == "", at),
        (hidden(key).isNotNull(), at),
        ((kind == "number") & unsafe_number(F.col("raw")).isNotNull(), "raw"),
        (hidden(F.col("value")).isNotNull(), at),
        ((kind == "array") & (F.col("child_count") >= LONG_ARRAY), at),
        ((kind == "object") & (F.col("child_count") >= WIDE_OBJECT), at),
        (F.col("string_length") >= LONG_STRING, at),
        ((kind == "array") & (F.col("child_count") == 0), at),
        ((kind == "object") & (F.col("child_count") == 0), at),
        (F.col("value") == "", at),
    ]
    rules = [(*r[:5], *w, r[5]) for r, w in zip(_TALLIES, when, strict=True)]
    flags = n.select("doc_id", "depth", "kind", *[F.when(r[5], F.col(r[6])).alias(f"x{i}") for i, r in enumerate(rules)])
    g = flags.groupBy("doc_id").agg(F.max("depth").alias("depth"), F.count_if(F.col("kind") == "string").alias("strings"), *[F.sort_array(F.collect_list(f"x{i}")).alias(f"x{i}") for i in range(len(rules))])
    tier = lambda sev, cat: F.lit({"warning": 0, "notice": 1, "info": 2}[sev] * 1000 + CATEGORY[cat] * 10)

    def row(rule, sev, cat, title, detail, count, ex, fires):
        s = F.struct(F.col("doc_id").cast("string").alias("subject"), F.lit(rule).alias("id"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"), title.alias("title"), F.lit(detail).alias("detail"), count.cast("bigint").alias("n"), F.slice(ex, 1, 12).alias("examples"), (F.size(ex) > 12).alias("examples_truncated"), tier(sev, cat).alias("priority"))
        return F.when(fires, s)

    made = []
    for i, (rule, sev, cat, title, detail, _, _, least) in enumerate(rules):
        k = F.size(f"x{i}")
        fires = k >= least if rule != "empty-strings" else (k >= least) & (k / F.nullif(F.col("strings"), F.lit(0)) >= 0.2)
        made.append(row(rule, sev, cat, F.lit(title), detail, k, F.col(f"x{i}"), fires))
    none = F.array().cast("array<string>")
    made.append(row("structure-depth", "info", "structure", F.when(F.col("depth") >= 2 * DEPTH, "Very deep nesting").otherwise("Deep nesting"), "Some readers limit the depth.", F.col("depth"), none, F.col("depth") >= DEPTH))
    return g.select(F.inline(F.array_compact(F.array(*made))))


def findings(n: DataFrame) -> DataFrame:
    """All findings, ``subject`` being the document.  ``n`` should be cached: every rule groups it.  Where the texts are at
    hand, ``document_findings`` has the same in one pass."""
    d, parts = F.col("doc_id"), []

    def out(rows, rule, sev, cat, title, detail, count, ex=None):
        parts.append(finding(rows, d, F.lit(rule) if isinstance(rule, str) else rule, sev, cat, CATEGORY[cat], title, detail, count, ex))

    k, ex = F.col("k"), F.col("ex")
    dup = duplicate_keys(n).groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list(F.concat("parent", F.lit("/"), "key"))).alias("ex"))
    out(dup, "dup-keys", "warning", "keys", "A key is repeated within an object", "Parsers keep one of the values and drop the others.", k, ex)
    case = n.where("key is not null").groupBy("doc_id", "parent", F.lower("key").alias("low")).agg(F.count_distinct("key").alias("v"), F.array_join(F.array_sort(F.collect_set("key")), " / ").alias("keys")).where("v > 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list("keys")).alias("ex"))
    out(case, "keys-case", "notice", "keys", "Keys differ only by case", "They may be meant to be one.", k, ex)
    mixed = n.where("key is null and parent is not null and kind != 'null'").groupBy("doc_id", "parent").agg(F.count_distinct("kind").alias("v")).where("v > 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list("parent")).alias("ex"))
    out(mixed, "types-mixed-array", "notice", "types", "Arrays of several kinds", "Their elements are not alike.", k, ex)
    shape = shapes(n).groupBy("doc_id", "array").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list(F.concat(F.array_join("keys", ","), F.lit(" x"), F.col("n")))).alias("ex")).where("k > 1")
    out(shape, F.concat(F.lit("shape-"), F.col("array")), "notice", "shape", "Objects of one array differ in their keys", "Some lack keys or have others.", k, ex)
    ft = field_types(n).where("rank > 1").groupBy("doc_id", "array").agg(F.sum("n").alias("k"), F.sort_array(F.collect_list("example")).alias("ex"))
    out(ft, F.concat(F.lit("types-field-"), F.col("array")), "notice", "types", "A field has several kinds", "Its values are not alike over the objects of the array.", k, ex)
    nl = nullability(n).where("present >= 3 and nulls / present >= 0.5").groupBy("doc_id", "array").agg(F.count(F.lit(1)).alias("k"), F.sort_array(F.collect_list("key")).alias("ex"))
    out(nl, F.concat(F.lit("null-"), F.col("array")), "info", "nulls", "Fields that are mostly null", "At least half of their values.", k, ex)
    parts.append(_tallied(n))
    return gather(n.sparkSession, parts)


def find(found: list[Node]) -> list[tuple]:
    """The findings on one scanned document: ``(id, severity, category, title, detail, n, examples)``.  The rules of
    ``findings``, places being compared by their pointers as there."""
    out: list[tuple] = []
    doubled: dict[tuple[str, str], int] = {}
    cased: dict[tuple[str, str], set[str]] = {}
    kinds: dict[str, set[str]] = {}
    elements: dict[str, list[str]] = {}  # objects by the array that they are elements of
    members: dict[str, dict[str, Node]] = {}  # by object: of repeated keys the last
    padded, unnamed, hid_keys, unsafe, hid_strings, arrays, objects, strings, no_items, no_members, blank = ([] for _ in range(11))
    n_strings = depth = 0
    for x in found:
        key, kind, parent, at = x.key, x.kind, x.parent, x.pointer
        depth = max(depth, x.depth)
        if key is not None:
            members.setdefault(parent, {})[key] = x
            cased.setdefault((parent, key.lower()), set()).add(key)
            if x.dup:
                doubled[parent, key] = 1
            if key == "":
                unnamed.append(at)
            elif key != py_trim(key):
                padded.append(at)
            if has_hidden(key):
                hid_keys.append(at)
        elif parent is not None:
            if kind != "null":
                kinds.setdefault(parent, set()).add(kind)
            if kind == "object":
                elements.setdefault(parent, []).append(at)
        if kind == "string":
            n_strings += 1
            if x.value == "":
                blank.append(at)
            elif has_hidden(x.value):
                hid_strings.append(at)
            if len(x.value) >= LONG_STRING:
                strings.append(at)
        elif kind == "number":
            if _unsafe(x.raw):
                unsafe.append(x.raw)
        elif kind == "array":
            if x.children >= LONG_ARRAY:
                arrays.append(at)
            elif not x.children:
                no_items.append(at)
        elif kind == "object":
            if x.children >= WIDE_OBJECT:
                objects.append(at)
            elif not x.children:
                no_members.append(at)

    def fire(rule: str, sev: str, cat: str, title: str, detail: str, ex: list[str], n: int | None = None) -> None:
        out.append((rule, sev, cat, title, detail, len(ex) if n is None else n, sorted(ex)))

    if doubled:
        fire("dup-keys", "warning", "keys", "A key is repeated within an object", "Parsers keep one of the values and drop the others.", [f"{p}/{k}" for p, k in doubled])
    case = [" / ".join(sorted(v)) for v in cased.values() if len(v) > 1]
    if case:
        fire("keys-case", "notice", "keys", "Keys differ only by case", "They may be meant to be one.", case)
    mixed = [p for p, v in kinds.items() if len(v) > 1]
    if mixed:
        fire("types-mixed-array", "notice", "types", "Arrays of several kinds", "Their elements are not alike.", mixed)
    for array, own in elements.items():
        if len(own) < 3:
            continue
        shaped = Counter(tuple(sorted(members.get(o, ()))) for o in own)
        if len(shaped) > 1:
            fire(f"shape-{array}", "notice", "shape", "Objects of one array differ in their keys", "Some lack keys or have others.", [f"{','.join(k)} x{n}" for k, n in shaped.items()])
        fields: dict[str, dict[str, list[str]]] = {}  # pointers by key and kind
        for o in own:
            for k, x in members.get(o, {}).items():
                fields.setdefault(k, {}).setdefault(x.kind, []).append(x.pointer)
        odd: list[list[str]] = []
        null = []
        for k, by in fields.items():
            present, nulls = sum(map(len, by.values())), len(by.pop("null", ()))
            if present >= 3 and nulls / present >= 0.5:
                null.append(k)
            if len(by) > 1:
                odd += [by[kind] for kind in sorted(by, key=lambda kind: (-len(by[kind]), kind))[1:]]
        if odd:
            fire(f"types-field-{array}", "notice", "types", "A field has several kinds", "Its values are not alike over the objects of the array.", [min(p) for p in odd], sum(map(len, odd)))
        if null:
            fire(f"null-{array}", "info", "nulls", "Fields that are mostly null", "At least half of their values.", null)
    for (rule, sev, cat, title, detail, least), ex in zip(_TALLIES, (padded, unnamed, hid_keys, unsafe, hid_strings, arrays, objects, strings, no_items, no_members, blank), strict=True):
        if len(ex) >= least and (rule != "empty-strings" or len(ex) / n_strings >= 0.2):
            fire(rule, sev, cat, title, detail, ex)
    if depth >= DEPTH:
        fire("structure-depth", "info", "structure", "Very deep nesting" if depth >= 2 * DEPTH else "Deep nesting", "Some readers limit the depth.", [], depth)
    return out


def _unsafe(raw: str) -> bool:
    if len(raw) < 16:  # neither 2^53 nor, but for an exponent, infinity
        return "e" in raw.lower() and abs(float(raw)) == float("inf")
    digits = raw.lstrip("-")
    return abs(float(raw)) == float("inf") or (digits.isdigit() and int(digits[:17]) > MAX_SAFE)  # strict JSON has no leading zeros


def document_findings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``findings(nodes(df, id_col, text_col))`` in one pass over the texts, without a shuffle: each rule looks at one document, and
    a document is scanned whole anyway.  Rows are documents of their own, also where ids repeat; texts with faults have none."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [*[pa.string()] * 6, pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int32()]

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            rows = []
            for d, src in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = scan(src or "")
                except JsonError:
                    continue
                for rule, sev, cat, title, detail, n, ex in find(found):
                    rows.append((d, _utf8(rule), sev, cat, title, detail, n, [_utf8(x) for x in ex[:12]], len(ex) > 12, TIER[sev] * 1000 + CATEGORY[cat] * 10))
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return df.select(F.col(id_col).cast("long").cast("string"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


# -- text again ----------------------------------------------------------------------------------------------------------
def render(src: str, indent: int | None = None, sort_keys: bool = False) -> str:
    """The document anew, scalars and repeated keys as they were written; keys sorted only where none is repeated."""
    found = scan(src)
    kids: dict[int, list[int]] = {}
    stack: list[int] = []
    for k, x in enumerate(found):
        while stack and found[stack[-1]].depth >= x.depth:
            stack.pop()
        if stack:
            kids.setdefault(stack[-1], []).append(k)
        stack.append(k)
    if sort_keys and any(x.dup for x in found):
        raise ValueError("keys are repeated; sorting would change what the document means")
    colon = ": " if indent else ":"
    done: dict[int, str] = {}
    for k in range(len(found) - 1, -1, -1):  # children come after their parents
        x = found[k]
        if x.kind not in ("object", "array"):
            done[k] = x.raw
            continue
        own = kids.get(k, [])
        if sort_keys and x.kind == "object":
            own = sorted(own, key=lambda c: found[c].key)
        parts = [(json.dumps(found[c].key, ensure_ascii=False) + colon if x.kind == "object" else "") + done.pop(c) for c in own]
        a, z = "{}" if x.kind == "object" else "[]"
        if indent and parts:
            pad = "\n" + " " * indent * (x.depth + 1)
            done[k] = a + pad + ("," + pad).join(parts) + "\n" + " " * indent * x.depth + z
        else:
            done[k] = a + ",".join(parts) + z
    return done[0]


def _rendered(**options):
    @arrow("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else render(x, **options)
            except ValueError:
                return None

        return s.map(one)

    return run


def pretty(text: Column, indent: int = 2) -> Column:
    return _rendered(indent=indent)(text)


def minified(text: Column) -> Column:
    return _rendered()(text)


def sorted_keys(text: Column, indent: int = 2) -> Column:
    """Null where a key is repeated."""
    return _rendered(indent=indent, sort_keys=True)(text)
