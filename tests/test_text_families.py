import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen.functions.jsre import PY_WS, WS_CHARS
from specimen.functions import cells
from specimen.functions import unicode as U
from specimen.operators import clean, inspect, profile, prose

CELLS = {
    "integer": ["42", "-42", "+7", "1,000", "$85,000", "1", "0", "8$5"], "decimal": ["3.14", ".5", "1e3", "1,000.50", "45%", "45 %", "€ 3"[:1] + "3.5"], "boolean": ["true", "false", "yes", "no", "YES", "No"], "date": ["2026-08-13", "2026/08/13", "2024-02-29"],
    "datetime": ["2026-08-13T10:30:00Z", "2026-08-13 10:30", "2026-08-13 10:30:11.123456789+0530"], "text": ["1,00", "12.34.56", "8O000", "12abc", "y", "08/13/2026", "13-08-2026", "2026-02-30", "2026-13-01", "Unknown", "1d", "NaN", "2026-1-5", "2026-08/13", "2026-08-13T24:00", "%"],
    "empty": ["", None], "whitespace": ["   ", "\t", "\xa0﻿"], "null-like": ["NULL", "N/A", "-", "None", " NA "],
}


def test_cells(spark):
    rows = [(k, v) for k, vs in CELLS.items() for v in vs]
    got = cells.classified(spark.createDataFrame(rows, "want string, raw string"))
    assert got.where("class != want").collect() == []
    assert {r["raw"]: r["num"]["value"] for r in got.where("raw in ('$85,000', '45%', '1e3')").collect()} == {"$85,000": 85000.0, "45%": 45.0, "1e3": 1000.0}


@pytest.mark.parametrize("tally,want", [({"integer": 10}, ("integer", 1.0)), ({"integer": 4, "decimal": 6}, ("decimal", 1.0)), ({"date": 8, "datetime": 2}, ("datetime", 1.0)), ({"integer": 99, "text": 1}, ("integer", 0.99)), ({"text": 9, "integer": 1}, ("text", 0.9)), ({"integer": 5, "text": 5}, ("mixed", 0.5)), ({}, ("empty", 1.0))])
def test_dominant_type(spark, tally, want):
    row = {f"n_{k}": tally.get(k, 0) for k in cells.VALUE_TYPES} | {"populated": sum(tally.values()), "boolean_shape": False}
    r = profile.dominant(spark.createDataFrame([row])).first()
    assert (r["dominant_type"], r["conformity"]) == want


def test_profile_of_a_messy_table(spark):
    rows = [(k, f"E{k}", "80000" if k else "8O000", ["Paris", "paris", "St. Louis", "St Louis", " Paris"][k % 5], "DE", "yes" if k % 2 else "no", None if k % 10 else "x", "N/A" if k == 3 else "a b") for k in range(16)]
    df = spark.createDataFrame([*rows, rows[5]], "k int, `Employee ID` string, salary string, city string, country string, active string, middle string, note string").coalesce(1)
    out = profile.profile_table(df.drop("k"))
    c = {r["name"]: r for r in out["columns"].collect()}
    assert c["salary"]["dominant_type"] == "integer" and c["active"]["dominant_type"] == "boolean" and c["country"]["is_constant"]
    ids = {r["id"] for r in out["findings"].collect()}
    assert {"type-integrity-1-anomaly", "consistency-2-caps", "consistency-2-similar", "whitespace-2-padded", "whitespace-2-variants", "consistency-3-constant", "completeness-ds-nulllike", "duplicates-ds-rows", "uniqueness-0-dupkey"} <= ids
    assert out["overview"].first()["duplicate_rows"] == 1
    first = profile.samples(profile.to_cells(df.drop("k"))).where("name = 'city'").orderBy("rank").collect()
    assert len(first) == 5 and first[0]["raw"] == "Paris"
    empty = profile.profile_table(df.where("false"))
    assert empty["columns"].collect() == [] and empty["findings"].collect() == []


CLEAN = [(None, "a \r\nb  ", "a\nb"), (["normalize-nbsp"], "a\u00a0b\u2003c", "a b\u2003c"), (["normalize-nbsp", "strip-trailing-whitespace"], "a\u00a0\n", "a\n"), (["remove-zero-width"], "a\u200bb\u2060c\u200dd", "abc\u200dd"), (["remove-zero-width"], "\ufeffa\ufeffb", "\ufeffab"), (["smart-quotes"], "\u201cx\u201d \u2018y\u2019", "\"x\" 'y'"), (["dashes-to-hyphen"], "\u2014\u2013\u2212", "---"), (["remove-controls"], "a\u0007b\tc\nd", "ab\tc\nd"), (["nfc-normalize"], "e\u0301", "\u00e9"), (["trim-document-edges"], "\ufeff \n a b\n", "a b"), (["remove-tags"], "a\U000e0041b", "ab"), (["strip-bom"], "\ufeffa\ufeff", "a\ufeff")]


def test_clean_vectors_and_idempotence(spark):
    for enabled, text, want in CLEAN:
        df = spark.createDataFrame([(text,)], "t string")
        once = clean.apply(F.col("t"), enabled)
        assert df.select(once).first()[0] == want
    mixed = spark.createDataFrame([("\ufeff a\u200b \u201cb\u201d\r\n\u00a0c\u2014\u0007\U000e0041\u202e x\ufe0f\u00ad e\u0301 \t\n",)], "t string")
    one = mixed.select(clean.apply(F.col("t"), list(clean.TRANSFORMS)).alias("t"))
    assert one.first()[0] == one.select(clean.apply(F.col("t"), list(clean.TRANSFORMS))).first()[0]
    n = mixed.select(clean.counts(F.col("t")).alias("n")).first()["n"]
    assert all(n[k] >= 1 for k in ("strip_bom", "normalize_nbsp", "smart_quotes", "dashes_to_hyphen", "remove_zero_width", "remove_controls", "remove_bidi", "remove_tags", "remove_soft_hyphens", "nfc_normalize"))
    with pytest.raises(ValueError):
        clean.apply(F.col("t"), ["no such"])


def test_inspection(spark):
    df = spark.createDataFrame([(1, "\ufeffab\r\nc\u200bd\tе\n\u202e👍"), (2, "plain text"), (3, None)], "id int, t string")
    got = [(r["pos"], r["line"], r["column"], r["category"]) for r in inspect.findings(df, "id", "t").orderBy("pos").collect()]
    assert got == [(0, 1, 1, "bom"), (6, 2, 2, "zero-width"), (8, 2, 4, "tab"), (9, 2, 5, "confusable-letter"), (11, 3, 1, "bidi")]
    s = df.select(inspect.stats(F.col("t")).alias("s"), inspect.line_endings(F.col("t")).alias("e"), inspect.trailing_whitespace(F.lit("a \nb\t\t")).alias("w"), inspect.expanded("t").alias("x")).first()
    assert s["s"]["utf16_units"] == s["s"]["code_points"] + 1 and s["e"]["mixed"] and s["e"]["dominant"] == "lf" and [tuple(x) for x in s["w"]] == [(1, 1), (2, 2)]
    assert s["x"].startswith("[BOM]ab[CRLF]\nc[ZWSP]d[TAB]е(U+0435)")
    assert U.classify(ord("ａ"))[2] == "a" and U.classify(0x1F600) is None and U.classify(0xFFFE)[0] == "noncharacter"
    top = inspect.summaries(inspect.findings(df, "id", "t")).first()
    assert top["category"] == "bidi"


def test_special_class_holds_what_classify_knows():
    import regex

    pattern = regex.compile("[" + regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", U.special_class()) + "]")
    for cp in [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE2000)]:
        assert bool(pattern.match(chr(cp))) >= bool(U.classify(cp)), hex(cp)


def _sentences_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    rows = df.select("k", F.flatten(F.transform(prose.paragraphs(F.col("t")), prose.sentences)).alias("s"), prose.structure(F.col("t")).alias("x")).orderBy("k").collect()
    return [(r["s"], r["x"]) for r in rows]


def test_sentences(spark):
    cases = [("Dr. Smith went home. He slept.", 2), ("Pi is 3.14 exactly. Yes.", 2), ("Meet at 5 p.m. today. Bring notes.", 2), ("Wait... really? Yes!", 3), ("", 0), ('He said "no." Then left', 2), ("The U.S.A. is far. So is e.g. Rome.", 2), ("One\n\nTwo\r\n \r\nThree", 3)]
    assert [len(s) for s, _ in _sentences_of(spark, [t for t, _ in cases])] == [n for _, n in cases]


def brute_sentences(paragraph):
    """A word ends a sentence if end marks, then closing marks, end it, but for a full stop behind an abbreviation."""
    import regex

    out, held = [], []
    for word in re.findall(f"[^{PY_WS}]+", paragraph):
        held.append(word)
        core = word.rstrip("\"'’”)]")
        marks = re.search(r"[.!?…]*\Z", core)[0]
        tail = regex.search(r"[\p{L}.]*\Z", core)[0]
        lone = marks == "." and (tail.replace(".", "").lower() in prose.ABBREVIATIONS or regex.search(r"\p{L}\.\p{L}\.\Z", tail))
        if marks and not lone:
            out.append(held)
            held = []
    return [*out, held] if held else out


def test_sentences_are_those_of_the_rule(spark):
    rng = random.Random(3)
    bits = ["a", "B", " ", " ", " ", ".", ".", "!", "?", '"', "'", "Dr", "e.g", "U.S", "3.1", "\n", "\u00a0", "…", "etc", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for text, (got, x) in zip(texts, _sentences_of(spark, texts), strict=True):
        paras = [p.strip(WS_CHARS) for p in re.split(r"\n[ \t]*\n", text)]
        want = [brute_sentences(p) for p in paras if p]
        flat = [s for p in want for s in p]
        assert ["".join(s) for s in flat] == [re.sub(f"[{PY_WS}]", "", s) for s in got], text
        assert (x["sentences"], x["paragraphs"], x["short_paragraphs"]) == (len(flat), len(want), sum(len(p) <= 1 for p in want)), text
        assert x["questions"] == sum(bool(re.search(r"""\?["'’”)\]]*\Z""", s[-1])) for s in flat), text


def test_openings_and_runs_of_short_sentences(spark):
    text = "We go. We run. We sit and talk for a long while here. They left. We won. Stop. Now."
    [(s, x)] = _sentences_of(spark, [text])
    assert len(s) == 7 and x["staccato_runs"] == 1 and x["opening_excess"] == 2  # four of seven begin with "we"


def test_prose_score(spark):
    plain = "The committee met on Tuesday and agreed the budget. It will publish the minutes next week, together with a list of open questions and their owners."
    slop = "The truth is this. Here's the thing about that. Let that sink in. Read that again. It's not a job, it's a calling. We must leverage synergy and circle back! LISTEN NOW!!! This is a game changer... Trust the process. Level up. Dream big. Not a plan, but a promise — really — truly — deeply."
    df = spark.createDataFrame([(1, plain), (2, slop), (3, None), (4, "don't stop")], "doc_id int, text string")
    got = {r["id"]: r for r in prose.score(df).collect()}
    assert got[1]["score"] < 15 and got[2]["score"] >= 40 and got[3]["score"] == 0 and got[4]["words"] == 2 and got[4]["too_short"]
    assert got[2]["contributions"]["canned-openers"] == 6
    for rule, a, z in prose.annotated(slop):
        assert slop[a:z] and rule in prose.RULES
    assert prose.findings(prose.score(df)).where("id = 2").count() == len(got[2]["contributions"])
    assert unicodedata.normalize("NFC", "é") == "é"
