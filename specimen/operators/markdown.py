"""Markdown to five destinations: rich (HTML), reddit, linkedin, slack, plain, with a report of what was lost.

Own parser for the parts of CommonMark and GFM that documents use: headings, paragraphs, nested lists and tasks, quotes,
fenced and indented code, rules, tables, HTML, definitions; emphasis, code, links, images, references, breaks.  A document is
a row; the trees stay inside the Arrow UDF and only texts, tallies and findings leave it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column

from ..functions.udf import arrow

#: How each plain destination shows things.
PLAIN = {
    "linkedin": {"quote": "wrap", "fence": False, "underline": False, "rule": "—"},
    "slack": {"quote": "prefix", "fence": True, "underline": True, "rule": "─" * 24},
    "plain": {"quote": "prefix", "fence": False, "underline": True, "rule": "─" * 24},
}
DESTINATIONS = ["rich", "reddit", *PLAIN]
WIDTH, MIN_COLUMN, MAX_ALIGNED, MAX_WRAPPED, UNDERLINE_CAP = 72, 5, 6, 4, 72
_SAFE = {"http", "https", "mailto", "tel"}


@dataclass
class Node:
    kind: str
    children: list["Node"] = field(default_factory=list)
    value: str = ""
    depth: int = 0
    url: str = ""
    start: int | None = None
    loose: bool = False
    checked: bool | None = None
    align: list[str | None] = field(default_factory=list)


# -- blocks --------------------------------------------------------------------------------------------------------------
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-*+]|[0-9]{1,9}[.)])(?:( {1,4})(?! )|( +)(?=\S)|[ \t]*$)")
_DEFINITION = re.compile(r" {0,3}\[([^\]\n]+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+[\"'(].*[\"')])?[ \t]*$")
_DIVIDER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?][^>]*>|!--)")


def _cells(row: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", row.strip().removeprefix("|"))
    if parts and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


class _Blocks:
    def __init__(self) -> None:
        self.definitions: dict[str, str] = {}

    def parse(self, lines: list[str]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                i += 1
            elif m := _FENCE.match(line):
                j = i + 1
                close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
                while j < len(lines) and not close.match(lines[j]):
                    j += 1
                cut = len(m[1])
                out.append(Node("code", value="\n".join(re.sub(f"^ {{0,{cut}}}", "", x) for x in lines[i + 1 : j])))
                i = j + 1
            elif line.startswith("    "):
                j = i
                while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
                    j += 1
                out.append(Node("code", value="\n".join(x[4:] for x in lines[i:j]).rstrip("\n ")))
                i = j
            elif m := _ATX.match(line):
                out.append(Node("heading", depth=len(m[1]), value=(m[2] or "").strip()))
                i += 1
            elif _RULE.match(line):
                out.append(Node("rule"))
                i += 1
            elif re.match(" {0,3}>", line):
                j = i
                while j < len(lines) and lines[j].strip() and (re.match(" {0,3}>", lines[j]) or not self._starts(lines[j])):
                    j += 1
                out.append(Node("quote", self.parse([re.sub("^ {0,3}> ?", "", x) for x in lines[i:j]])))
                i = j
            elif _ITEM.match(line):
                node, i = self._list(lines, i)
                out.append(node)
            elif m := _DEFINITION.match(line):
                self.definitions.setdefault(m[1].strip().lower(), m[2])
                i += 1
            elif "|" in line and i + 1 < len(lines) and _DIVIDER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
                align = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":"))) for c in _cells(lines[i + 1])]
                rows, j = [_cells(line)], i + 2
                while j < len(lines) and lines[j].strip() and "|" in lines[j]:
                    rows.append(_cells(lines[j]))
                    j += 1
                out.append(Node("table", [Node("row", [Node("cell", value=c) for c in r]) for r in rows], align=align))
                i = j
            elif _HTML.match(line):
                j = i
                while j < len(lines) and lines[j].strip():
                    j += 1
                out.append(Node("html", value="\n".join(lines[i:j])))
                i = j
            else:
                j = i + 1
                setext = None
                while j < len(lines) and lines[j].strip():
                    if setext := re.match(r" {0,3}(=+|-+)[ \t]*$", lines[j]):
                        break
                    if self._starts(lines[j], in_paragraph=True):
                        break
                    j += 1
                text = "\n".join(x.lstrip() for x in lines[i:j])
                if setext:
                    out.append(Node("heading", depth=1 if setext[1][0] == "=" else 2, value=text.strip()))
                    j += 1
                else:
                    out.append(Node("paragraph", value=text.rstrip()))
                i = j
        return out

    @staticmethod
    def _starts(line: str, in_paragraph: bool = False) -> bool:
        item = _ITEM.match(line)
        if item and in_paragraph:
            # only a list from 1, and no empty item, may interrupt a paragraph
            item = line[item.end() :].strip() and (not item[2][0].isdigit() or int(item[2][:-1]) == 1)
        return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or re.match(" {0,3}>", line) or item)

    def _list(self, lines: list[str], i: int) -> tuple[Node, int]:
        first = _ITEM.match(lines[i])
        mark = first[2][-1]
        node = Node("list", start=int(first[2][:-1]) if first[2][0].isdigit() else None)
        while i < len(lines):
            m = _ITEM.match(lines[i])
            if not m or m[2][-1] != mark or _RULE.match(lines[i]):
                break
            indent = len(m[1]) + len(m[2]) + (len(m[3]) if m[3] else 1)
            own, i = [lines[i][m.end() if m[3] else len(m[1]) + len(m[2]) + 1 :]], i + 1
            while i < len(lines):
                if not lines[i].strip():
                    if i + 1 < len(lines) and (lines[i + 1].startswith(" " * indent) or not lines[i + 1].strip()):
                        own.append("")
                        i += 1
                        continue
                    break
                if lines[i].startswith(" " * indent):
                    own.append(lines[i][indent:])
                elif own[-1].strip() and not self._starts(lines[i]) and not _ITEM.match(lines[i]):
                    own.append(lines[i].lstrip())
                else:
                    break
                i += 1
            item = Node("item")
            if task := re.match(r"\[([ xX])\][ \t]+(?=\S)", own[0]):
                item.checked, own[0] = task[1] != " ", own[0][task.end() :]
            while own and not own[-1].strip():
                own.pop()
            item.loose = any(not x.strip() for x in own)
            item.children = self.parse(own)
            node.children.append(item)
            k = i
            while k < len(lines) and not lines[k].strip():
                k += 1
            nxt = _ITEM.match(lines[k]) if k < len(lines) else None
            if nxt and nxt[2][-1] == mark and not _RULE.match(lines[k]):
                node.loose |= k > i
                i = k
        node.loose |= any(c.loose for c in node.children)
        return node, i


# -- inline --------------------------------------------------------------------------------------------------------------
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_LINK_TAIL = re.compile(r"""\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^)\\]|\\.)*\)))?\s*\)""")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)>")
_BARE = re.compile(r"(?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~)'\"]")
_TAG = re.compile(r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?|!--.*?--|![A-Z][^>]*|\?.*?\?)>", re.S)
_RUN = re.compile(r"\*+|_+|~~")


def inline(text: str, defs: dict[str, str]) -> list[Node]:
    out: list[Node] = []
    buf: list[str] = []

    def flush():
        if buf:
            out.append(Node("text", value=html.unescape("".join(buf))))
            buf.clear()

    def closing(i: int) -> int:
        depth = 0
        while i < len(text):
            if text[i] == "\\":
                i += 1
            elif text[i] == "`" and (m := re.compile("(`+)(?!`).*?(?<!`)\\1(?!`)", re.S).match(text, i)):
                i = m.end() - 1
            elif text[i] == "[":
                depth += 1
            elif text[i] == "]":
                depth -= 1
                if not depth:
                    return i
            i += 1
        return -1

    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and (m := _ESCAPE.match(text, i)):
            buf.append(html.escape(m[1], quote=False))
            i = m.end()
        elif c == "\n" or (c == "\\" and text[i + 1 : i + 2] == "\n"):
            hard = c == "\\" or "".join(buf).endswith("  ")
            while buf and buf[-1].endswith(" "):
                buf[-1] = buf[-1].rstrip(" ")
                if not buf[-1]:
                    buf.pop()
            i += 2 if c == "\\" else 1
            if hard:
                flush()
                out.append(Node("break"))
            else:
                buf.append("\n")
        elif c == "`" and (m := re.compile("(`+)(?!`)(.*?)(?<!`)\\1(?!`)", re.S).match(text, i)):
            flush()
            body = m[2].replace("\n", " ")
            out.append(Node("code-span", value=body[1:-1] if body.startswith(" ") and body.endswith(" ") and body.strip() else body))
            i = m.end()
        elif c == "<" and (m := _AUTO.match(text, i)):
            flush()
            out.append(Node("link", [Node("text", value=m[1])], url=m[1] if ":" in m[1] else f"mailto:{m[1]}"))
            i = m.end()
        elif c == "<" and (m := _TAG.match(text, i)):
            flush()
            out.append(Node("html-span", value=m[0]))
            i = m.end()
        elif (c == "[" or (c == "!" and text[i + 1 : i + 2] == "[")) and (end := closing(i + (c == "!"))) > 0:
            image = c == "!"
            label = text[i + 1 + image : end]
            m = _LINK_TAIL.match(text, end + 1)
            ref = None if m else re.compile(r"\[([^\]]*)\]").match(text, end + 1)
            url = _ESCAPE.sub(r"\1", m[1] if m[1] is not None else m[2] or "") if m else defs.get(((ref and ref[1]) or label).strip().lower())
            if url is None:
                buf.append(c)
                i += 1
                continue
            flush()
            kids = inline(label, defs)
            out.append(Node("image", value=plain_text(kids), url=url) if image else Node("link", kids, url=url))
            i = (m or ref).end() if m or ref else end + 1
        elif c in "*_~" and (m := _RUN.match(text, i)):
            run = m[0]
            before, after = text[i - 1 : i], text[m.end() : m.end() + 1]
            opens = bool(after) and not after.isspace() and not (c == "_" and before.isalnum())
            done = False
            for size in ([2] if c == "~" else [3, 2, 1]):
                if not opens or len(run) < size:
                    continue
                mark = re.escape(c * size)
                word = r"(?![^\W_])" if c == "_" else ""
                close = re.compile(rf"(?<![\s\\{re.escape(c)}]){mark}(?!{re.escape(c)}){word}")
                at = m.end() - (len(run) - size)
                z = close.search(text, at + 1) if len(run) == size else None
                if z:
                    flush()
                    kids = inline(text[m.end() : z.start()], defs)
                    node = Node({1: "emphasis", 2: "strike" if c == "~" else "strong", 3: "strong"}[size], kids)
                    out.append(Node("emphasis", [node]) if size == 3 else node)
                    i, done = z.end(), True
                    break
            if not done:
                buf.append(run)
                i = m.end()
        elif c in "hw" and not (i and (text[i - 1].isalnum())) and (m := _BARE.match(text, i)):
            flush()
            out.append(Node("link", [Node("text", value=m[0])], url=m[0] if m[0].startswith("http") else f"http://{m[0]}"))
            i = m.end()
        else:
            buf.append(c)
            i += 1
    flush()
    return out


def plain_text(nodes: list[Node]) -> str:
    return "".join(n.value + plain_text(n.children) for n in nodes)


def parse(source: str) -> tuple[list[Node], dict[str, str]]:
    """Blocks with inline children, and link definitions."""
    b = _Blocks()
    blocks = b.parse(source.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"))

    def fill(nodes: list[Node]) -> None:
        for n in nodes:
            if n.kind in ("heading", "paragraph", "cell"):
                n.children, n.value = inline(n.value, b.definitions), ""
            else:
                fill(n.children)

    fill(blocks)
    return blocks, b.definitions


# -- width ---------------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=65536)
def _cluster_width(g: str) -> int:
    c = g[0]
    if unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
        return 0
    wide = unicodedata.east_asian_width(c) in "WF" or "️" in g or 0x1F1E6 <= ord(c) <= 0x1F1FF
    return 2 if wide else 1


def display_width(text: str) -> int:
    """Columns of a monospaced display: wide characters two, marks none, flags two."""
    return len(text) if text.isascii() and text.isprintable() else sum(map(_cluster_width, regex.findall(r"\X", text)))


def pad(text: str, width: int, align: str | None = None) -> str:
    room = max(0, width - display_width(text))
    left = room if align == "right" else room // 2 if align == "center" else 0
    return " " * left + text + " " * (room - left)


# -- tables --------------------------------------------------------------------------------------------------------------
def _grid(header: list[str], rows: list[list[str]]) -> list[int]:
    return [max([3, *(display_width(r[c]) for r in [header, *rows])]) for c in range(len(header))]


def _natural(header, rows) -> int:
    return sum(_grid(header, rows)) + 3 * len(header) + 1


def layout(header: list[str], rows: list[list[str]], destination: str, asked: str = "auto") -> str:
    """aligned, wrapped or records."""
    if destination not in ("plain", "slack") or asked == "records":
        return "records"
    if len(header) <= MAX_ALIGNED and _natural(header, rows) <= WIDTH:
        return "aligned"
    return "wrapped" if asked == "aligned" or len(header) <= MAX_WRAPPED else "records"


def _wrap(text: str, width: int) -> list[str]:
    lines, line = [], ""
    for word in text.split():
        while display_width(word) > width:
            cut = 0
            clusters = regex.findall(r"\X", word)
            used = 0
            for g in clusters:
                if used + _cluster_width(g) > width and cut:
                    break
                used += _cluster_width(g)
                cut += len(g)
            if line:
                lines.append(line)
                line = ""
            lines.append(word[:cut])
            word = word[cut:]
        if line and display_width(line) + 1 + display_width(word) > width:
            lines.append(line)
            line = word
        elif word:
            line = f"{line} {word}".strip()
    return [*lines, line] if line or not lines else lines


def aligned_table(header: list[str], rows: list[list[str]], align: list[str | None], target: int = WIDTH) -> str:
    """A bordered table; columns are narrowed, the widest first, until it fits, and their cells wrapped."""
    widths = _grid(header, rows)
    room = max(len(header), target - 3 * len(header) - 1)
    while sum(widths) > room:
        k = max(range(len(widths)), key=lambda c: (widths[c] > min(_grid(header, rows)[c], MIN_COLUMN), widths[c]))
        if widths[k] <= min(_grid(header, rows)[k], MIN_COLUMN):
            break
        widths[k] -= 1

    def show(cells: list[str]) -> list[str]:
        parts = [_wrap(c, w) for c, w in zip(cells, widths, strict=True)]
        return ["| " + " | ".join(pad(p[k] if k < len(p) else "", w, a) for p, w, a in zip(parts, widths, align, strict=True)) + " |" for k in range(max(map(len, parts)))]

    return "\n".join([*show(header), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *[x for r in rows for x in show(r)]])


def record_table(header: list[str], rows: list[list[str]]) -> str:
    """A labelled block for each row."""
    if not rows:
        return "\n".join(h for h in header if h)
    out = []
    for r in rows:
        first = r[0] if not header[0] or re.search(r"\s", r[0]) else f"{header[0]} {r[0]}" if r[0] else f"{header[0]}:"
        out.append("\n".join([first] * bool(first) + [f"{h}: {v}" if v else f"{h}:" for h, v in zip(header[1:], r[1:], strict=True)]))
    return "\n\n".join(out)


# -- renderers -----------------------------------------------------------------------------------------------------------
def safe_url(url: str) -> str | None:
    url = re.sub(r"[\x00-\x1f\x7f-\x9f]", "", url).strip()
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    return url if url and (not m or m[1].lower() in _SAFE) else None


class _Tally(dict):
    def __missing__(self, key):
        return 0


class _Renderer:
    def __init__(self, destination: str, table_layout: str) -> None:
        self.to, self.asked, self.n, self.tables = destination, table_layout, _Tally(), []
        self.policy = PLAIN.get(destination, {})

    def table(self, n: Node) -> tuple[list[str], list[list[str]], list[str | None]]:
        rows = [["".join(self.span(x) for x in c.children).replace("\n", " ").strip() for c in r.children] for r in n.children]
        width = max([len(n.align), *map(len, rows)])
        rows = [r + [""] * (width - len(r)) for r in rows]
        return rows[0], rows[1:], n.align + [None] * (width - len(n.align))

    # plain text
    def span(self, n: Node) -> str:
        kids = lambda: "".join(self.span(c) for c in n.children)
        if n.kind in ("strong", "emphasis", "strike"):
            self.n[n.kind] += 1
            return kids()
        if n.kind == "code-span":
            self.n["code_spans"] += 1
            return f"`{n.value}`"
        if n.kind == "break":
            return "\n"
        if n.kind in ("link", "image"):
            self.n[f"{n.kind}s"] += 1
            label, url = (kids() if n.kind == "link" else n.value), n.url.strip()
            return label if not url else url if label.strip() in ("", url) else f"{label} ({url})"
        if n.kind == "html-span":
            self.n["html"] += 1
        return n.value

    def blocks(self, nodes: list[Node], sep: str = "\n\n") -> str:
        return sep.join(x for x in (self.block(n) for n in nodes) if x.strip())

    def block(self, n: Node) -> str:
        k = n.kind
        self.n[{"heading": "headings", "list": "lists", "quote": "quotes", "code": "code_blocks", "rule": "rules", "html": "html"}.get(k, k)] += 1
        if k in ("paragraph", "heading"):
            text = "".join(self.span(c) for c in n.children)
            if k == "heading" and self.policy["underline"] and n.depth < 3 and text.strip():
                text += "\n" + "═─"[n.depth - 1] * max(1, min(display_width(text.replace("\n", " ")), UNDERLINE_CAP))
            return text
        if k == "list":
            out = []
            for i, item in enumerate(n.children):
                mark = f"{n.start + i}. " if n.start is not None else "• "
                if item.checked is not None:
                    self.n["tasks"] += 1
                    mark = "☑ " if item.checked else "☐ "
                body = self.blocks(item.children, "\n\n" if item.loose else "\n")
                out.append((mark + body.replace("\n", "\n" + " " * display_width(mark))).rstrip() if body else mark.rstrip())
            return re.sub(r"\n +\n", "\n\n", ("\n\n" if n.loose else "\n").join(out))
        if k == "quote":
            body = self.blocks(n.children)
            return f"“{body}”" if self.policy["quote"] == "wrap" else "\n".join(f"> {x}".rstrip() for x in body.split("\n"))
        if k == "code":
            return f"```\n{n.value}\n```" if self.policy["fence"] else n.value
        if k == "rule":
            return self.policy["rule"]
        if k == "table":
            header, rows, align = self.table(n)
            how = layout(header, rows, self.to, self.asked) if rows else "aligned"
            self.tables.append((len(header), len(rows), "records" if how == "records" else "aligned"))
            text = record_table(header, rows) if how == "records" else aligned_table(header, rows, align)
            return f"```\n{text}\n```" if how != "records" and self.policy["fence"] else text
        return n.value


class _Rich(_Renderer):
    def span(self, n: Node) -> str:
        kids = lambda: "".join(self.span(c) for c in n.children)
        tag = {"strong": "strong", "emphasis": "em", "strike": "del"}.get(n.kind)
        if tag:
            self.n[n.kind] += 1
            return f"<{tag}>{kids()}</{tag}>"
        if n.kind == "code-span":
            self.n["code_spans"] += 1
            return f"<code>{html.escape(n.value, quote=False)}</code>"
        if n.kind == "break":
            return "<br>"
        if n.kind in ("link", "image"):
            self.n[f"{n.kind}s"] += 1
            label = (kids() if n.kind == "link" else html.escape(n.value, quote=False)) or html.escape(n.url, quote=False)
            url = safe_url(n.url)
            return f'<a href="{html.escape(url)}">{label}</a>' if url else label
        self.n["html"] += n.kind == "html-span"
        return html.escape(n.value, quote=False)

    def blocks(self, nodes: list[Node], sep: str = "") -> str:
        return sep.join(self.block(n) for n in nodes)

    def block(self, n: Node) -> str:
        k = n.kind
        self.n[{"heading": "headings", "list": "lists", "quote": "quotes", "code": "code_blocks", "rule": "rules", "html": "html"}.get(k, k)] += 1
        if k in ("paragraph", "heading"):
            tag = "p" if k == "paragraph" else f"h{n.depth}"
            return f"<{tag}>{''.join(self.span(c) for c in n.children)}</{tag}>"
        if k == "list":
            tag = "ul" if n.start is None else "ol"
            items = []
            for item in n.children:
                mark = ""
                if item.checked is not None:
                    self.n["tasks"] += 1
                    mark = "☑ " if item.checked else "☐ "
                body = "".join("".join(self.span(x) for x in c.children) if c.kind == "paragraph" and not (n.loose or item.loose) else self.block(c) for c in item.children)
                items.append(f"<li>{mark}{body}</li>")
            return f"<{tag}" + (f' start="{n.start}"' if n.start not in (None, 1) else "") + f">{''.join(items)}</{tag}>"
        if k == "quote":
            return f"<blockquote>{self.blocks(n.children)}</blockquote>"
        if k == "code":
            return f"<pre><code>{html.escape(n.value, quote=False)}</code></pre>"
        if k == "rule":
            return "<hr>"
        if k == "table":
            header, rows, align = self.table(n)
            self.tables.append((len(header), len(rows), "html"))
            cell = lambda tag, x, a: f"<{tag}" + (f' style="text-align:{a}"' if a else "") + f">{x}</{tag}>"
            line = lambda tag, r: f"<tr>{''.join(cell(tag, x, a) for x, a in zip(r, align, strict=True))}</tr>"
            return f"<table><thead>{line('th', header)}</thead><tbody>{''.join(line('td', r) for r in rows)}</tbody></table>"
        return f"<p>{html.escape(n.value, quote=False)}</p>"


class _Reddit(_Renderer):
    def span(self, n: Node, in_link: bool = False) -> str:
        kids = lambda link=in_link: "".join(self.span(c, link) for c in n.children)
        mark = {"strong": "**", "emphasis": "*", "strike": "~~"}.get(n.kind)
        if mark:
            self.n[n.kind] += 1
            return f"{mark}{kids()}{mark}"
        if n.kind == "code-span":
            self.n["code_spans"] += 1
            ticks = "`" * (1 + max([0, *map(len, re.findall("`+", n.value))]))
            return f"{ticks}{n.value}{ticks}"
        if n.kind == "break":
            return "  \n"
        if n.kind == "link":
            self.n["links"] += 1
            return f"[{kids(True)}]({n.url})"
        if n.kind == "image":
            self.n["images"] += 1
            return n.value if in_link else f"[{n.value or n.url}]({n.url})"
        if n.kind == "html-span":
            self.n["html"] += 1
            return n.value
        return re.sub(r"([\\`*_\[\]~])", r"\\\1", n.value)

    def block(self, n: Node) -> str:
        k = n.kind
        self.n[{"heading": "headings", "list": "lists", "quote": "quotes", "code": "code_blocks", "rule": "rules", "html": "html"}.get(k, k)] += 1
        if k in ("paragraph", "heading"):
            return ("#" * n.depth + " ") * (k == "heading") + "".join(self.span(c) for c in n.children)
        if k == "list":
            out = []
            for i, item in enumerate(n.children):
                mark = f"{n.start + i}. " if n.start is not None else "- "
                task = ""
                if item.checked is not None:
                    self.n["tasks"] += 1
                    task = "☑ " if item.checked else "☐ "
                body = self.blocks(item.children, "\n\n" if item.loose or n.loose else "\n")
                out.append((mark + task + body.replace("\n", "\n" + " " * len(mark))).rstrip())
            return re.sub(r"\n +\n", "\n\n", ("\n\n" if n.loose else "\n").join(out))
        if k == "quote":
            return "\n".join(f"> {x}".rstrip() for x in self.blocks(n.children).split("\n"))
        if k == "code":
            fence = "`" * max(3, 1 + max([0, *map(len, re.findall("`+", n.value))]))
            return f"{fence}\n{n.value}\n{fence}"
        if k == "rule":
            return "---"
        if k == "table":
            header, rows, align = self.table(n)
            self.tables.append((len(header), len(rows), "pipe"))
            line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in r) + " |"
            bar = "|" + "|".join({"left": ":---", "right": "---:", "center": ":---:"}.get(a, "---") for a in align) + "|"
            return "\n".join([line(header), bar, *map(line, rows)])
        return n.value


def transform(source: str | None, destination: str = "plain", table_layout: str = "auto") -> dict:
    """``output``, ``status`` (preserved, adapted, compromised), ``findings`` (category, impact, count), ``tables``."""
    if destination not in DESTINATIONS:
        raise ValueError(f"unknown destination {destination}")
    r = {"rich": _Rich, "reddit": _Reddit}.get(destination, _Renderer)(destination, table_layout)
    output = r.blocks(parse(source or "")[0]).strip("\n")
    plain, n, found = destination in PLAIN, r.n, []

    def say(category: str, impact: str, count: int) -> None:
        if count:
            found.append((category, impact, count))

    say("tables", "compromised" if any(t[2] == "records" for t in r.tables) else "adapted" if plain else "preserved", len(r.tables))
    say("headings", "adapted" if plain else "preserved", n["headings"])
    say("emphasis", "compromised" if plain else "preserved", n["strong"] + n["emphasis"] + n["strike"])
    say("links", "adapted" if plain else "preserved", n["links"])
    say("images", "compromised" if plain else "adapted", n["images"])
    say("code", "adapted" if destination in ("plain", "linkedin") else "preserved", n["code_blocks"] + n["code_spans"])
    say("quotes", "adapted" if plain else "preserved", n["quotes"])
    say("tasks", "adapted", n["tasks"])
    say("rules", "adapted" if plain else "preserved", n["rules"])
    say("html", "compromised" if destination == "rich" else "adapted", n["html"])
    worst = next((i for i in ("compromised", "adapted") if any(f[1] == i for f in found)), "preserved")
    return {"output": output, "status": worst, "findings": found, "tables": r.tables}


def transform_column(text: Column, destination: str = "plain", table_layout: str = "auto") -> Column:
    @arrow("output string, status string, findings array<struct<category:string,impact:string,n:int>>, tables array<struct<columns:int,rows:int,representation:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            t = transform(x, destination, table_layout)
            rows.append((t["output"], t["status"], [dict(zip(("category", "impact", "n"), f, strict=True)) for f in t["findings"]], [dict(zip(("columns", "rows", "representation"), f, strict=True)) for f in t["tables"]]))
        return pd.DataFrame(rows, columns=["output", "status", "findings", "tables"])

    return run(text)
