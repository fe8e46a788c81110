"""Reports on small result frames, as Markdown or JSON; and texts as files."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import ordered


def number(x: float | int | None) -> str:
    """Thousands grouped; at most four decimals, scientific beyond 10^15."""
    if x is None or (isinstance(x, float) and not math.isfinite(x)):
        return "–"
    if abs(x) >= 1e15:
        return f"{x:.4g}"
    return f"{x:,.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else f"{x:,}"


def percent(x: float | None) -> str:
    return "–" if x is None else "100%" if x == 1 else "0%" if x == 0 else "<0.1%" if x < 0.001 else ">99.9%" if x > 0.999 else f"{x * 100:.1f}%"


def size(n: int) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def _cell(x) -> str:
    return ("" if x is None else str(x)).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    rows = df.limit(limit).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(_cell(x) for x in r)} |\n" for r in rows)


def table_report(profile: dict[str, DataFrame], title: str = "Table profile") -> str:
    """The profile of a table as Markdown: overview, columns, findings.  Never the data."""
    o = profile["overview"].first()
    cols = profile["columns"].orderBy("col").select("name", "dominant_type", "populated", "n_distinct", "completeness", "candidate_key").collect()
    out = [f"# {title}", "", f"{number(o['n_rows'] or 0)} rows, {number(o['n_columns'])} columns, {number(o['duplicate_rows'])} duplicate rows", "", "## Columns", "", "| name | type | values | distinct | complete | key |", "|---|---|---|---|---|---|"]
    out += [f"| {_cell(c['name'])} | {c['dominant_type']} | {number(c['populated'])} | {number(c['n_distinct'])} | {percent(c['completeness'])} | {c['candidate_key']} |" for c in cols]
    return "\n".join([*out, "", "## Findings", "", *findings_list(profile["findings"])]) + "\n"


def findings_list(findings: DataFrame, limit: int = 500) -> list[str]:
    rows = ordered(findings).limit(limit).collect()
    return [f"- **{r['severity']}** {r['title']}" + (f" ({r['subject']})" if r["subject"] else "") + f": {number(r['n'])}. {r['detail']}" for r in rows] or ["Nothing was found."]


def table_json(profile: dict[str, DataFrame]) -> str:
    rows = lambda k: [r.asDict(recursive=True) for r in profile[k].collect()]
    return json.dumps({"overview": rows("overview")[0], "columns": rows("columns"), "findings": [r.asDict(recursive=True) for r in ordered(profile["findings"]).collect()]}, ensure_ascii=False, default=str, indent=2)


def json_report(structure: DataFrame, shapes: DataFrame, findings: DataFrame, title: str = "JSON profile") -> str:
    """Markdown on JSON documents; shapes only where an array has more than one."""
    varied = shapes.groupBy("doc_id", "array").agg(F.count(F.lit(1)).alias("variants"), F.max("share").alias("conformity")).where("variants > 1")
    out = [f"# {title}", "", markdown_table(structure)]
    if not varied.isEmpty():
        out += ["## Shapes", "", markdown_table(varied.orderBy("doc_id", "array"))]
    return "\n".join([*out, "## Findings", "", *findings_list(findings)]) + "\n"


def write_texts(df: DataFrame, text_col: str, path: str) -> None:
    """One text per line of files; line breaks inside texts stay as they are."""
    df.select(F.col(text_col).cast("string").alias("value")).write.text(path)
