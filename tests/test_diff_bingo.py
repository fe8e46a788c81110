import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen.operators import bingo as B
from specimen.operators import diff as D


@settings(max_examples=400)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
def test_scripts_are_shortest_and_rebuild(a, b):
    ops, degraded = D.edit_script(a, b)
    assert not degraded and ops.count("-") + ops.count("+") == len(a) + len(b) - 2 * D.lcs_length(a, b)
    i = j = 0
    for op in ops:
        if op == "=":
            assert a[i] == b[j]
        i, j = i + (op != "+"), j + (op != "-")
    assert (i, j) == (len(a), len(b))


def test_scripts():
    assert D.edit_script(list("xay"), list("xby")) == ("=-+=", False)
    assert D.edit_script([1, 2, 3, 4, 5], [6, 7, 8, 9, 10], 1) == ("-----+++++", True)
    c = D.compare("one two three", "one four three")
    assert (c["inserted"], c["deleted"], c["regions"]) == (1, 1, 1) and c["segments"] == [["=", "one "], ["-", "two"], ["+", "four"], ["=", " three"]]


VERDICTS = [("same", "same", "identical"), ("", "x", "empty-vs-nonempty"), ("a\r\nb\r\nc", "a\nb\nc", "line-endings"), ("a  b", "a b", "whitespace"), ("a b", "a b", "whitespace"), ("Hello World", "hello world", "case"), ("Café", "Café", "nfc"), ("it's", "it’s", "punctuation"), ("a...b", "a…b", "punctuation"), ("ab", "a​b", "invisibles"), ("﻿abc", "abc", "invisibles"), ("pаy", "pay", "homoglyph"), ("Hello  World", "hello world", "cosmetic"), ("cat", "dog", "different")]


@pytest.mark.parametrize("a,b,kind", VERDICTS)
def test_verdicts(a, b, kind):
    assert D.verdict(a, b)[0] == kind and D.verdict(b, a)[0] == kind


def test_subtle_and_dimensions():
    assert set(D.verdict("Hello  World", "hello world")[1]) == {"case", "whitespace"}
    assert [x[:2] for x in D.subtle("pаy it's", "pay it’s")] == [("homoglyph", "warning"), ("punctuation", "notice")]
    assert D.subtle("completely", "unlike that") == [] and ("line-endings", "info", 2) in D.subtle("a\r\nb", "a\nb")


def apply_patch(a, patch):
    """Apply a unified diff to the lines of ``a``."""
    lines, out, at = D.tokens(a, "line"), [], 0
    for row in patch.splitlines()[2:]:
        if row.startswith("@@"):
            start, n = map(int, row.split()[1][1:].split(","))
            first = start - 1 if n else start
            out += [x for x, _ in lines[at:first]]
            at = first
        elif row.startswith(" "):
            out.append(lines[at][0])
            at += 1
        elif row.startswith("-"):
            at += 1
        elif row.startswith("+"):
            out.append(row[1:])
    return out + [x for x, _ in lines[at:]]


@settings(max_examples=200)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_patches_apply(a, b):
    x, y = "".join(c + "\n" for c in a), "".join(c + "\n" for c in b)
    assert apply_patch(x, D.unified(x, y) or "--- A\n+++ B\n") == b


def test_patch_text():
    assert D.unified("a\nb", "a\nb\n") == "--- A\n+++ B\n@@ -1,2 +1,2 @@\n a\n-b\n\\ No newline at end of file\n+b\n"
    assert D.unified("x", "x") == "" and "Verdict: case" in D.summary("A", "a")


def test_columns(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in VERDICTS], "a string, b string")
    got = df.select(D.verdict_column("a", "b").alias("v"), D.diff_column(F.col("a"), F.col("b"), "char", ignore_case=True).alias("d"), D.subtle_column("a", "b").alias("s"), D.unified_column("a", "b").alias("u"), D.verdict_native(F.col("a"), F.col("b")).alias("n"), D.side_stats(F.col("a")).alias("t")).collect()
    assert [r["v"]["kind"] for r in got] == [v for *_, v in VERDICTS]
    assert got[5]["d"]["inserted"] == 0 and got[5]["n"] == "case" and got[12]["n"] == "cosmetic" and got[2]["t"]["endings"]["crlf"] == 2


def test_bingo(spark):
    df = spark.createDataFrame([("Circle Back\ncircle back\nCIRCLE   BACK\nsynergy",), ("a\nb\r\nc\rd\n\n  \n",), ("Café\nCAFÉ\ncafé",)], "t string").coalesce(1)
    assert [r["phrase"] for r in B.deck(df, "t").orderBy("pos").collect()] == ["Circle Back", "synergy", "a", "b", "c", "d", "Café"]
    assert not B.valid_deck(B.deck(df, "t")).first()["valid"]
    phrases = [f"phrase {k}" for k in range(40)]
    c = B.card(phrases, 3)
    assert c == B.card(phrases, 3) and c[12] == "FREE" and len(set(c)) == 25
    dealt = B.deal(spark.createDataFrame([(p,) for p in phrases], "phrase string"), 3).collect()
    assert len(dealt) == 3 and all(len(set(r["cells"])) == 25 and r["cells"][12] == "FREE" for r in dealt)
    rng = random.Random(1)
    masks = [rng.getrandbits(25) | rng.getrandbits(25) for _ in range(50)] + [0, 2**25 - 1]
    got = spark.createDataFrame([(m,) for m in masks], "m long").select("m", B.completed(B.marks_of_mask(F.col("m"))).alias("l")).collect()
    for r in got:
        marks = [bool(r["m"] >> k & 1) or k == 12 for k in range(25)]
        assert r["l"] == [n for n, at in B.LINES if all(marks[i] for i in at)]
    assert B.load(B.dump(c, B.fresh())) == (c, B.fresh()) and B.load("{}") is None and B.load("[1") is None
    assert B.toggle(B.fresh(), 0)[0] and B.toggle(B.fresh(), 12)[12] and "1 of 25" in B.progress(B.fresh())
    s = spark.createDataFrame([(c,)], "c array<string>").select(B.serial("c")).first()[0]
    assert len(s) == 4 and s == s.upper()
    with pytest.raises(ValueError):
        B.card(["x"])


def test_patches_and_scripts_of_long_texts_take_linear_space():
    rng = random.Random(11)
    a = [f"line {rng.randrange(400)}" for _ in range(3000)]
    b = [x if rng.random() > 0.2 else f"new {rng.randrange(400)}" for x in a if rng.random() > 0.1]
    ops, degraded = D.edit_script(a, b)
    assert not degraded and len(ops) - ops.count("=") == len(a) + len(b) - 2 * D.lcs_length(a, b)
    x, y = "\n".join(a) + "\n", "\n".join(b) + "\n"
    assert apply_patch(x, D.unified(x, y)) == b


def test_limits_are_asked_for():
    a, b = "ab" * 7000, "ab" * 7000 + "c"
    assert not D.compare(a, b, "char")["disabled"] and D.compare(a, b, "char", gate=D.CHAR_GATE)["disabled"]
    many = " ".join(f"w{k}" for k in range(600)), " ".join(f"w{k}" if k % 2 else f"v{k}" for k in range(600))
    assert len(D.compare(*many)["segments"]) == 900 and D.compare(*many, cap=60)["capped"] and not D.compare(*many)["capped"]
    assert D.subtle("a" * 21_000, "a" * 21_000 + "\u200b") and not D.subtle("a" * 21_000, "a" * 21_000 + "\u200b", gate=D.SUBTLE_GATE)
    assert D.places("ab\r\ncd\ne", [0, 1, 4, 6, 7]) == [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1)] and D.nfkc("\ufb01") == "fi"


def test_lines_of_marks_and_masks_agree(spark):
    from specimen.operators import bingo

    rng = random.Random(12)
    masks = [rng.getrandbits(25) | rng.getrandbits(25) for _ in range(300)] + [0, (1 << 25) - 1]
    df = spark.createDataFrame([(m,) for m in masks], "m long")
    for r in df.select("m", bingo.completed(bingo.marks_of_mask(F.col("m"))).alias("a"), bingo.completed_of_mask(F.col("m")).alias("b")).collect():
        assert r["a"] == r["b"]
