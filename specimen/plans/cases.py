"""Queries over worked cases: every row of a table gets one of a family's published cases, and the SQL gives what the case's
rule says must come out, written out by hand.  They reach what no relation of the driver's tables holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import diff, inspect, jsondoc, profile, prose, rx
from ..operators import temporal as T
from ..sources import delimited
from .tables import table

QUERIES, ORACLES = {}, {}
_SHORT = {"events": "event_id", "orders": "o_orderkey", "documents": "doc_id", "part": "p_partkey", "pages": "page_id"}


def quoted(x: str | int | None) -> str:
    """A value in SQL; characters that cannot be seen by number."""
    if x is None:
        return "NULL"
    if isinstance(x, int):
        return str(x)
    parts, held = [], ""
    for c in x:
        if c.isprintable() and c.isascii():
            held += c.replace("'", "''")
        else:
            parts += ([f"'{held}'"] if held else []) + [f"chr({ord(c)})"]
            held = ""
    return " || ".join(parts + ([f"'{held}'"] if held or not parts else []))


def dealt(spark, sf_dir: str, name: str, cases: list[tuple], spread: bool = False) -> DataFrame:
    """``id`` and the inputs of the case that each row gets, as ``a``, ``b`` and so on; the last of a case is its result.
    ``spread``: ids are dealt out to all tasks first, for cases that take time, since one task reads a whole row group."""
    rows = table(spark, sf_dir, name).select(F.col(_SHORT[name]).cast("bigint").alias("id"))
    if spread:
        rows = rows.repartition("id")
    k = F.pmod(F.col("id"), F.lit(len(cases))).cast("int")
    pick = lambda j: F.get(F.array(*[F.lit(c[j]) for c in cases]), k).alias("abcd"[j])
    return rows.select("id", *[pick(j) for j in range(len(cases[0]) - 1)])


def worked(name: str, source: str, cases: list[tuple], run: Callable[[DataFrame], DataFrame], absent: str | None = None, spread: bool = False) -> None:
    """Register ``run`` (a frame of ``id`` and inputs to one of ``id`` and ``out``).  Where a case's result is ``absent``, no row comes out."""

    def query(spark, sf_dir):
        return run(dealt(spark, sf_dir, source, cases, spread)).select("id", "out")

    QUERIES[name] = query
    key = f"CAST({_SHORT[source]} AS BIGINT)"
    values = ", ".join(quoted(c[-1]) for c in cases)
    sql = f"SELECT {key} AS id, ([{values}])[CAST({key} % {len(cases)} AS INT) + 1] AS out FROM {source}"
    ORACLES[name] = sql if absent is None else f"SELECT * FROM ({sql}) WHERE out <> {quoted(absent)}"


def mapped(column: Callable[..., Column]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("id", column(*[F.col(c) for c in df.columns[1:]]).alias("out"))


# -- characters ----------------------------------------------------------------------------------------------------------
_PLACED = [("a\u200bb", "1:2:zero-width"), ("x\ny\u00a0z", "2:2:unusual-space"), ("\ufeffa\r\n\u202eb", "1:1:bom 2:1:bidi"), ("plain text", ""), ("\t\u0430", "1:1:tab 1:2:confusable-letter"), ("a\u0007", "1:2:control"), ("a\rb\rc\u00ad", "3:2:soft-hyphen"), ("\u201cx\u201d \u2014", "1:1:confusable-quote 1:3:confusable-quote 1:5:confusable-dash"), ("\U0001f44d\ufe0f", "1:2:variation-selector"), ("\U000e0041x\ue000", "1:1:tag 1:3:private-use"), ("\u2028\ufffd\u3164", "1:1:vertical-whitespace 1:2:replacement 1:3:blank")]


def _placed(df: DataFrame) -> DataFrame:
    found = inspect.findings(df, "id", "a")
    return found.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(":", "line", "column", "category").alias("x")))), lambda x: x["x"]), " ").alias("out"))


worked("text_finding_places", "events", _PLACED, _placed, absent="")

_TOLD = [("a\u200b\u200bb\u202e", "bidi:danger:1 zero-width:warning:2"), ("\t\t\u00a0", "tab:info:0 unusual-space:warning:1"), ("\u2019s \u2026", "confusable-punctuation:notice:1 confusable-quote:notice:1"), ("plain", "")]


def _told(df: DataFrame) -> DataFrame:
    s = inspect.summaries(inspect.findings(df, "id", "a"))
    return s.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "category", "severity", "headline"))), " ").alias("out"))


worked("text_finding_summaries", "events", _TOLD, _told, absent="")
worked("text_reveals", "documents", [("\ufeffa\u200bb", "[BOM]a[ZWSP]b"), ("x\r\ny\n", "x[CRLF]\ny[LF]\n"), ("\tq\u00a0", "[TAB]q[NBSP]"), ("p\u0430y", "p\u0430(U+0430)y"), ("\u0007\u007f\u0085", "[^G][^?][NEL]"), ("\u202ex\u2069", "[RLO]x[PDI]"), ("plain", "plain")], mapped(inspect.expanded))
worked("text_notation", "events", [(0x200B, "U+200B ^U+200B"), (7, "U+0007 ^^G"), (127, "U+007F ^^?"), (0x1F600, "U+1F600 ^U+1F600")], mapped(lambda a: F.concat(inspect.notation(a), F.lit(" ^"), inspect.abbreviation(a))))

# -- prose: what a rule's arithmetic gives, rounded half up ---------------------------------------------------------------
_SIX = "We went to the old market in town. We bought some bread and fresh cheese. We saw three ships in the harbour. We ate on the wall beside the church. Then the rain came down very hard. Everybody ran home through the narrow streets."
_PROSE = [
    ("The truth is this. Here's the thing about that.", "canned-openers=6"),
    ("Let that sink in. Read that again.", "audience-commands=7"),
    ("It\u2019s not a job, it\u2019s a calling.", "contrast-template=4"),
    ("Synergy and bandwidth.", "corporate-jargon=3"),
    ("Trust the process.", "content-cliches=2"),
    ("LISTEN NOW PEOPLE.", "all-caps=6"),
    ("one \u2014 two \u2014 three", "em-dash=2"),
    ("Stop! Now!", "exclamation=3"),
    ("Well... fine...", "ellipsis=3"),
    ("hi \U0001f44d", "emoji=2"),
    ("- a b\n- c d\n- e f\n- g h\n- i j\n- k l", "list-heading-density=6"),
    ("Go. Run. Sit. The old man went home to his wife. He ate some bread and cheese there. They talked about the weather for hours.", "staccato-fragments=5"),
    (_SIX, "repeated-openings=3"),
    ("Why does it rain here every day? Who would want to live there? Can anybody see the sea from here? The town is small and quiet now. People leave when they are young enough. Nobody comes back to the old harbour.", "rhetorical-questions=7"),
    ("\n\n".join(["The committee met again on Tuesday", "Minutes will follow before the weekend", "Questions were few and soon answered", "Nobody spoke against the new budget", "All members then went home early"]), "one-sentence-paragraphs=12"),
    ("The committee met on Tuesday and agreed the budget.", ""),
    ("", ""),
]


def _contributions(df: DataFrame) -> DataFrame:
    s = prose.score(df, "id", "a")
    return s.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("contributions"), lambda e: F.concat_ws("=", e["key"], e["value"]))), " ").alias("out"))


worked("prose_rules", "documents", _PROSE, _contributions)
worked("prose_bands", "events", [(s, b) for s, b in ((0, "human"), (19, "human"), (20, "linkedin"), (39, "linkedin"), (40, "content"), (69, "content"), (70, "thought-leadership"), (100, "thought-leadership"))], mapped(prose.band))
_ARITHMETIC = [("occ", 3, "9.00"), ("occ", 4, "12.00"), ("dens", 3, "0.00"), ("dens", 10, "5.71"), ("ratio", 50, "3.00"), ("ratio", 100, "12.00"), ("ratio", 30, "0.00")]
worked("prose_points", "events", _ARITHMETIC, mapped(lambda a, b: F.format_string("%.2f", F.when(a == "occ", prose.occurrence_points(b, 3, 12)).when(a == "dens", prose.density_points(b, F.lit(600), 140, 1, 8)).otherwise(prose.ratio_points(b / 100, 0.35, 20, 12)))))
worked("prose_findings", "documents", [(t, x.replace("=", ":")) for t, x in _PROSE[:10]], lambda df: prose.findings(prose.score(df, "id", "a")).select("id", F.concat_ws(":", "rule", "contribution").alias("out")))
worked("prose_evidence", "documents", [("The truth is this.", "canned-openers:0-12"), ("OK but WOW!", "all-caps:7-10 exclamation:10-11"), ("No \u2026 yes", "ellipsis:3-4"), ("plain words", "")], mapped(lambda a: F.array_join(F.transform(prose.evidence(a), lambda e: F.concat(e["rule"], F.lit(":"), e["start"], F.lit("-"), e["end"])), " ")))

# -- comparison ----------------------------------------------------------------------------------------------------------
_PAIRS = [("same", "same", "identical"), ("", "x", "empty-vs-nonempty"), ("a\r\nb\r\nc", "a\nb\nc", "line-endings"), ("a\u00a0b", "a b", "whitespace"), ("Hello World", "hello world", "case"), ("Caf\u00e9", "Cafe\u0301", "nfc"), ("it's", "it\u2019s", "punctuation"), ("a...b", "a\u2026b", "punctuation"), ("ab", "a\u200bb", "invisibles"), ("abc", "\ufeffabc", "invisibles"), ("pay", "p\u0430y", "homoglyph"), ("Hello  World", "hello world", "cosmetic case whitespace"), ("cat", "dog", "different")]
worked("diff_verdict_cases", "events", _PAIRS, lambda df: df.select("id", diff.verdict_column("a", "b").alias("v")).select("id", F.array_join(F.concat(F.array("v.kind"), F.array_sort("v.dimensions")), " ").alias("out")))
_COUNTED = [("one two three", "one four three", "1 1 1"), ("a b c", "a b c", "0 0 0"), ("a b", "a b c", "2 0 1"), ("x y z", "x z", "0 2 1"), ("", "a", "1 0 1"), ("a-b", "a+b", "1 1 1")]
_tell = lambda mode: lambda df: df.select("id", diff.diff_column(F.col("a"), F.col("b"), mode).alias("d")).select("id", F.concat_ws(" ", "d.inserted", "d.deleted", "d.regions").alias("out"))
worked("diff_word_counts", "events", _COUNTED, _tell("word"))
worked("diff_char_counts", "events", [("cafe\u0301", "caf\u00e9", "1 1 1"), ("abc", "abXc", "1 0 1"), ("kitten", "sitting", "3 2 3"), ("\U0001f44d\U0001f3fd", "\U0001f44d", "1 1 1")], _tell("char"))
worked("diff_line_counts", "events", [("a\nb\nc\n", "a\nB\nc\n", "1 1 1"), ("a\n", "a\nb\n", "1 0 1"), ("a\r\nb", "a\nb", "0 0 0"), ("a\nb\nc\nd\n", "b\nd\n", "0 2 2")], _tell("line"))
worked("diff_subtle_findings", "events", [("ab", "a\u200bb", "invisibles:warning:1"), ("it's fine", "it\u2019s fine", "punctuation:notice:1"), ("pay me", "p\u0430y me", "homoglyph:warning:1"), ("Caf\u00e9 au lait", "Cafe\u0301 au lait", "nfc:notice:1"), ("a\r\nb\r\nc", "a\nb\nc", "line-endings:info:4"), ("cat", "dog", ""), ("same", "same", "")], lambda df: df.select("id", F.array_join(F.transform(diff.subtle_column("a", "b"), lambda x: F.concat_ws(":", x["dimension"], x["severity"], x["n"])), " ").alias("out")))
_HEAD = "--- A\n+++ B\n"
_PATCHES = [
    ("a\nb\n", "a\nb\n", ""),
    ("a\nb", "a\nb\n", _HEAD + "@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+b\n"),
    ("1\n2\n3\n4\n5\n6\n7\n8\n9\n", "1\n2\n3\n4\nfive\n6\n7\n8\n9\n", _HEAD + "@@ -2,7 +2,7 @@\n 2\n 3\n 4\n-5\n+five\n 6\n 7\n 8\n"),
    ("", "new\n", _HEAD + "@@ -0,0 +1,1 @@\n+new\n"),
    ("old\n", "", _HEAD + "@@ -1,1 +0,0 @@\n-old\n"),
    ("a\n" + "x\n" * 9 + "b\n", "A\n" + "x\n" * 9 + "B\n", _HEAD + "@@ -1,4 +1,4 @@\n-a\n+A\n x\n x\n x\n@@ -8,4 +8,4 @@\n x\n x\n x\n-b\n+B\n"),
    ("a\n" + "x\n" * 6 + "b\n", "A\n" + "x\n" * 6 + "B\n", _HEAD + "@@ -1,8 +1,8 @@\n-a\n+A\n" + " x\n" * 6 + "-b\n+B\n"),
]
worked("diff_patches", "events", _PATCHES, mapped(diff.unified_column))
worked("diff_sides", "events", [("don't stop\n", "11 11 2 11 lf true"), ("e\u0301", "2 1 1 3 none false"), ("\U0001f44d\r\n", "3 2 0 6 crlf true")], lambda df: df.select("id", diff.side_stats(F.col("a")).alias("s")).select("id", F.concat_ws(" ", "s.code_points", "s.graphemes", "s.words", "s.bytes", "s.endings.dominant", "s.final_newline").alias("out")))

# -- time ----------------------------------------------------------------------------------------------------------------
def _parsed(mode: str, unit: str = "auto", system: str = "1900"):
    return lambda df: df.select("id", T.parse_column(F.col("a"), mode, unit, system).alias("p")).select("id", F.concat_ws(" ", "p.status", "p.unit", "p.iso", "p.code").alias("out"))


worked("time_auto_cases", "events", [("0", "instant seconds 1970-01-01T00:00:00Z"), ("1786998240", "instant seconds 2026-08-17T20:24:00Z"), ("1786998240000", "instant milliseconds 2026-08-17T20:24:00Z"), ("-1000000000", "instant seconds 1938-04-24T22:13:20Z"), ("2026-08-17T16:24:00+05:45", "instant 2026-08-17T10:39:00Z"), ("  ", "empty"), ("2026-08-17", "local 2026-08-17T00:00:00")], _parsed("auto"))
worked("time_iso_errors", "events", [("2026-02-30", "error invalid-date"), ("2026-08-17Z", "error malformed-iso"), ("2026-08-17T25:00:00Z", "error invalid-time"), ("2024-02-29T23:59:59Z", "instant 2024-02-29T23:59:59Z"), ("2026-08-17 16:24", "local 2026-08-17T16:24:00")], _parsed("iso"))
worked("time_excel_1900", "events", [("1", "local 1900-01-01T00:00:00"), ("59", "local 1900-02-28T00:00:00"), ("60", "error excel-phantom"), ("61", "local 1900-03-01T00:00:00"), ("25569", "local 1970-01-01T00:00:00"), ("1.5", "local 1900-01-01T12:00:00"), ("61.25", "local 1900-03-01T06:00:00"), ("0", "error excel-zero"), ("-1", "error excel-negative")], _parsed("excel"))
worked("time_unix_seconds", "events", [("1786998240.123456789", "instant seconds 2026-08-17T20:24:00.123456789Z"), ("1000000000", "instant seconds 2001-09-09T01:46:40Z"), ("8640000000000", "instant seconds +275760-09-13T00:00:00Z"), ("8640000000001", "error out-of-range"), ("x", "error not-numeric")], _parsed("unix", "seconds"))
_WALLS = [("2026-06-15 12:00", "America/New_York", "unique 2026-06-15T16:00:00Z -14400 0"), ("2026-11-01 01:30", "America/New_York", "ambiguous 2026-11-01T05:30:00Z -14400 60"), ("2026-04-05 01:45", "Australia/Lord_Howe", "ambiguous 2026-04-04T14:45:00Z 39600 30"), ("2026-03-08 02:30", "America/New_York", "gap 2026-03-08T07:30:00Z -18000 60"), ("2026-10-04 02:15", "Australia/Lord_Howe", "gap 2026-10-03T15:45:00Z 37800 30"), ("1870-06-01 12:00", "America/New_York", "unique 1870-06-01T16:56:02Z -17762 0"), ("2026-01-01 00:00", "Nowhere/Land", "unknown-zone")]


def _resolved(df: DataFrame) -> DataFrame:
    wall = T.parse_column(F.col("a"), "local")["wall_ns"]
    r = df.select("id", T.resolve_column(wall, F.col("b")).alias("r"))
    at = F.date_format(F.timestamp_seconds((F.col("r.chosen_ns") / 10**9).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return r.select("id", F.concat_ws(" ", "r.status", at, "r.earlier_offset", "r.shift_minutes").alias("out"))


worked("time_zone_cases", "events", _WALLS, _resolved)
worked("time_zone_facts", "events", [("2026-07-01 00:00:00", "America/New_York", "-240 true true"), ("2026-01-01 00:00:00", "America/New_York", "-300 false true"), ("2026-01-01 00:00:00", "Australia/Lord_Howe", "660 true true"), ("2026-07-01 00:00:00", "Asia/Kathmandu", "345 false false"), ("2026-07-01 00:00:00", "UTC", "0 false false")], lambda df: df.select("id", T.zone_facts(F.col("a").cast("timestamp_ntz"), F.col("b")).alias("f")).select("id", F.concat_ws(" ", "f.offset_minutes", "f.dst", "f.observes_dst").alias("out")))
worked("time_epoch_seconds", "events", [("1786998240123456789", "1786998240.123456789"), ("1000000000", "1"), ("-1500000000", "-1.5"), ("100000000000", "100")], mapped(lambda a: T.epoch_seconds(a.cast("decimal(38,0)"))))
worked("time_relative_cases", "events", [(0, "just now"), (59, "just now"), (60, "in 1 minute"), (-3600, "1 hour ago"), (86400, "tomorrow"), (-86400, "yesterday"), (2592000, "next month"), (-31536000, "last year"), (63072000, "in 2 years"), (-5184000, "2 months ago")], mapped(T.relative))

# -- patterns ------------------------------------------------------------------------------------------------------------
_RUNS = [("a", "g", "banana", "1:a 3:a 5:a"), (r"\d+", "g", "a12b345", "1:12 4:345"), ("a", "y", "aab", "0:a"), ("a", "y", "baa", ""), ("^", "gm", "x\ny", "0: 2:"), (r"\b", "g", "hi there", "0: 2: 3: 8:"), ("", "g", "ab", "0: 1: 2:"), (r"(\d{4})-(\d{2})", "", "on 2026-08", "3:2026-08"), (r"(?<y>\d)\k<y>", "g", "1122 13", "0:11 2:22"), (r"A.C", "gis", "a\nc", "0:a\nc")]


def _runs(spark, sf_dir):
    out = None
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("id"))
    for k, (source, flags, text, _) in enumerate(_RUNS):
        own = pages.where(F.col("id") % len(_RUNS) == k).withColumn("t", F.lit(text))
        m = rx.matches(own, "id", "t", source, flags).select("id", F.struct("ordinal", F.concat_ws(":", "start", "value").alias("x")).alias("m"))
        out = m if out is None else out.union(m)
    return out.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["x"]), " ").alias("out"))


QUERIES["regex_flags"] = _runs
ORACLES["regex_flags"] = f"SELECT * FROM (SELECT page_id AS id, ([{', '.join(quoted(c[-1]) for c in _RUNS)}])[CAST(page_id % {len(_RUNS)} AS INT) + 1] AS out FROM pages) WHERE out <> ''"


def _captured(spark, sf_dir):
    m = rx.matches(table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x\n  "), "page_id", F.lit("-ab")).alias("t")), "page_id", "t", r"(\d+)-(?:(z)|(?<w>a))(q*)", "")
    g = lambda k, f: F.element_at("groups", k)[f]
    return m.select(F.col("id").alias("page_id"), "line", "column", g(1, "value").alias("first"), g(2, "value").alias("second"), g(3, "value").alias("third"), g(3, "name").alias("third_name"), g(4, "value").alias("fourth"), g(1, "start").alias("start"))


QUERIES["regex_captures"] = _captured
ORACLES["regex_captures"] = "SELECT page_id, 2 AS line, 3 AS column, CAST(page_id AS VARCHAR) AS first, NULL::VARCHAR AS second, 'a' AS third, 'w' AS third_name, '' AS fourth, 4 AS start FROM pages"

# -- JSON ----------------------------------------------------------------------------------------------------------------
worked("json_errors", "events", [("", "empty"), ('{"a":1}', "ok"), ('{"a":1,}', "error 1:8"), ("[1 2]", "error 1:4"), ('{"a":\n tru}', "error 2:2"), ("[01]", "error 1:3"), ('{"a" 1}', "error 1:6"), ("\ufeff[]", "error 1:1")], lambda df: df.select("id", jsondoc.errors("a").alias("e")).select("id", F.concat_ws(" ", "e.status", F.when(F.col("e.line").isNotNull(), F.concat_ws(":", "e.line", "e.column"))).alias("out")))
worked("json_pretty", "events", [('{"b":1.50,"a":[true,null]}', '{\n  "b": 1.50,\n  "a": [\n    true,\n    null\n  ]\n}'), ("[]", "[]"), ('{"x":{}}', '{\n  "x": {}\n}'), ('"s"', '"s"')], mapped(jsondoc.pretty))
worked("json_sorted", "events", [('{"b":1,"a":{"d":2,"c":3}}', '{\n  "a": {\n    "c": 3,\n    "d": 2\n  },\n  "b": 1\n}'), ('{"a":1,"a":2}', None), ("[2,1]", "[\n  2,\n  1\n]")], mapped(jsondoc.sorted_keys))
_SAMPLES = [('{"a":1,"a":2}', "dup-keys:1"), ('{"id":1,"ID":2}', "keys-case:1"), ('[1,"a"]', "types-mixed-array:1"), ('[{"id":1,"name":"a"},{"id":2,"name":"b"},{"id":3,"fullName":"c"}]', "shape-:2"), ('[{"amount":1},{"amount":2},{"amount":"x"}]', "types-field-:1"), ('{"n":9007199254740993}', "numbers-unsafe:1"), ('{" k ":1,"":2}', "keys-empty:1 keys-whitespace:1"), ('{"k\u200b":"v\u200b"}', "keys-hidden:1 strings-hidden:1"), ('[{"n":null},{"n":null},{"n":1}]', "null-:1"), ('{"a":1}', "")]


def _sample_findings(df: DataFrame) -> DataFrame:
    f = jsondoc.document_findings(df, "id", "a")
    return f.groupBy(F.col("subject").cast("bigint").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "id", "n"))), " ").alias("out"))


worked("json_rules", "events", _SAMPLES, _sample_findings, absent="", spread=True)

# -- delimited text ------------------------------------------------------------------------------------------------------
_TEXTS = [("name,age,city\nAda,36,London\nGrace,40,NYC\nAlan,41,Cambridge\nEdsger,50,Austin\n", ", true 4 3 0 0 0"), ("a,b\n1,2\n\n3,4\n5,6\n", ", true 4 2 1 0 0"), ("a,b,c\n1,2,3\n4,5\n6,7,8,9\n1,2,3\n", ", true 4 3 0 2 0"), ("1,2,3\n4,5,6\n7,8,9\n10,11,12\n", ", false 4 3 0 0 0"), ("a,b,c\n", ", true 0 3 0 0 0"), ("x;y\r\n1;2\r\n3;4\r\n5;6\r\n", "; true 3 2 0 0 0")]


def _structures(df: DataFrame) -> DataFrame:
    s = delimited.structure(delimited.read_rows(df, "id", "a"))
    return s.select("id", F.concat_ws(" ", "delimiter", "has_header", "n_rows", "n_columns", "n_blank", "n_ragged", "n_quote_faults").alias("out"))


worked("csv_structure_cases", "events", _TEXTS, _structures)

_ALL = ["k", "row id", "constant", "near", "empty", "sparse", "padded", "similar", "blank", "null words", "mixed", "numbers"]


def _every_rule(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cells = ["p_partkey", "CASE WHEN p_partkey = 2 THEN 1 ELSE p_partkey END", "'x'", "CASE WHEN p_partkey % 50 = 0 THEN 'rare' ELSE 'usual' END", "CAST(NULL AS STRING)", "CASE WHEN p_partkey % 20 = 0 THEN concat('v', p_partkey) END", "CASE p_partkey % 3 WHEN 0 THEN ' red ' WHEN 1 THEN 'red' ELSE 'Red' END", "CASE WHEN p_partkey % 2 = 0 THEN 'New York' ELSE 'new york.' END", "CASE WHEN p_partkey % 4 = 0 THEN '   ' ELSE 'w' END", "CASE p_partkey % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN '-' ELSE CAST(p_partkey AS STRING) END", "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS STRING) ELSE concat('word', p_partkey) END", "CASE WHEN p_partkey % 100 = 0 THEN 'oops' ELSE CAST(p_partkey % 7 AS STRING) END"]
    return p.select(*[F.expr(e).cast("string").alias(n) for e, n in zip(cells, _ALL, strict=True)])


def csv_every_rule(spark, sf_dir):
    return profile.profile_table(_every_rule(spark, sf_dir))["findings"].select("subject", "id", "severity", "n")


QUERIES["csv_every_rule"] = csv_every_rule
_COUNT = lambda when: f"count(*) FILTER ({when})"
_FIRED = [("k", "uniqueness-0-candidatekey", "info", "count(*)"), ("row id", "uniqueness-1-dupkey", "warning", "least(count(*), 1)"), ("constant", "consistency-2-constant", "info", "count(*)"), ("near", "consistency-3-nearconstant", "info", _COUNT("p_partkey % 50 <> 0")), ("empty", "completeness-4-empty", "notice", "count(*)"), ("sparse", "completeness-5-sparse", "notice", _COUNT("p_partkey % 20 <> 0")), ("padded", "whitespace-6-padded", "notice", _COUNT("p_partkey % 3 = 0")), ("padded", "consistency-6-caps", "notice", "least(count(*), 1)"), ("padded", "whitespace-6-variants", "notice", "least(count(*), 1)"), ("similar", "consistency-7-similar", "notice", "least(count(*), 1)"), ("blank", "whitespace-8-only", "notice", _COUNT("p_partkey % 4 = 0")), ("blank", "consistency-8-constant", "info", _COUNT("p_partkey % 4 <> 0")), (None, "completeness-ds-nulllike", "info", _COUNT("p_partkey % 4 < 2")), ("mixed", "type-integrity-10-mixed", "info", "count(*)"), ("mixed", "uniqueness-10-candidatekey", "info", "count(*)"), ("numbers", "type-integrity-11-anomaly", "warning", _COUNT("p_partkey % 100 = 0"))]
ORACLES["csv_every_rule"] = " UNION ALL ".join(f"SELECT {quoted(s)}::VARCHAR AS subject, '{i}' AS id, '{v}' AS severity, CAST({n} AS BIGINT) AS n FROM part" for s, i, v, n in _FIRED)


def csv_overview(spark, sf_dir):
    return profile.profile_table(_every_rule(spark, sf_dir))["overview"].select("n_columns", "n_rows", "n_cells", "n_populated", "n_key_candidates", "duplicate_rows", "duplicate_groups")


QUERIES["csv_overview"] = csv_overview
ORACLES["csv_overview"] = f"SELECT CAST(12 AS BIGINT) AS n_columns, count(*) AS n_rows, count(*) * 12 AS n_cells, count(*) * 7 + {_COUNT('p_partkey % 20 = 0')} + {_COUNT('p_partkey % 4 <> 0')} + {_COUNT('p_partkey % 4 >= 2')} + count(*) AS n_populated, CAST(3 AS BIGINT) AS n_key_candidates, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS duplicate_groups FROM part"


def csv_preview(spark, sf_dir):
    shown = profile.preview(table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name")).alias("a"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise("NULL").alias("b")))
    return shown.select("a", F.concat_ws("|", F.transform("blank_kinds", lambda x: F.coalesce(x, F.lit("value")))).alias("marks"), "blank_row")


QUERIES["csv_preview"] = csv_preview
ORACLES["csv_preview"] = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'empty' ELSE 'value' END || '|' || CASE WHEN n_nationkey % 3 = 0 THEN 'whitespace' ELSE 'null-like' END AS marks, n_nationkey % 6 = 0 AS blank_row FROM nation"
