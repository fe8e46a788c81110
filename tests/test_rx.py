import pytest
from pyspark.sql import functions as F

from specimen.operators import rx as R

RUNS = [("a", "g", "banana", [(1, "a"), (3, "a"), (5, "a")]), (r"\d+", "g", "a12b345", [(1, "12"), (4, "345")]), ("a", "y", "aab", [(0, "a")]), ("a", "y", "baa", []), ("a", "gy", "aab", [(0, "a"), (1, "a")]), ("^", "gm", "x\ny", [(0, ""), (2, "")]), (r"\b", "g", "hi there", [(0, ""), (2, ""), (3, ""), (8, "")]), ("", "g", "ab", [(0, ""), (1, ""), (2, "")]), (r"\bé", "g", "é", []), (r"[^\d]+", "g", "a1bc", [(0, "a"), (2, "bc")]), (r"[\S]+", "g", "a b", [(0, "a"), (2, "b")]), (r"(?<y>\d)\k<y>", "g", "1122 13", [(0, "11"), (2, "22")]), (r"\u{1F44D}", "u", "x👍", [(1, "👍")]), (r"a.c", "g", "a\nc abc", [(4, "abc")]), (r"a.c", "gs", "a\nc", [(0, "a\nc")]), (r"(?<!x)y{2,3}?", "g", "xyyyy", [(2, "yy")]), (r"[]", "g", "a", []), (r"[^]", "g", "a", [(0, "a")]), (r"\w+", "gi", "straße", [(0, "stra"), (5, "e")])]


@pytest.mark.parametrize("source,flags,text,want", RUNS)
def test_run(source, flags, text, want):
    assert [(m.start(), m[0]) for m in R.run(source, flags, text)[0]] == want


def test_captures_cap_and_time():
    (m,), _ = R.run(r"(\d{4})-(\d{2})", "d", "2026-08")
    assert m.span(1) == (0, 4) and m.span(2) == (5, 7)
    assert R.run("(a)|(b)", "", "a")[0][0][2] is None and R.run("(x*)y", "", "y")[0][0][1] == ""
    assert R.run("a", "g", "aaa", cap=3)[1] is False and R.run("a", "g", "aaa", cap=2)[1] is True
    with pytest.raises(TimeoutError):
        R.run("(a|aa)+$", "", "a" * 60 + "b", timeout=0.2)


@pytest.mark.parametrize("source,flags", [("(", ""), ("a**", ""), ("[b-a]", ""), (r"\1", ""), (r"(?<a>x)(?<a>y)", ""), ("a{2,1}", ""), ("x", "q"), ("x", "uv"), ("x", "gg"), ("[a", ""), (")", ""), ("a\\", ""), (r"\k<z>(?<a>x)", ""), (r"\-\y", "u")])
def test_errors(source, flags):
    with pytest.raises(R.PatternError):
        R.compiled(source, flags)


def test_analysis():
    assert [x[0] for x in R.lints("(a+)+", "")] == ["nested-quantifier"] and [x[0] for x in R.lints("a*", "g")] == ["global-zero-width"] and [x[0] for x in R.lints("a?", "")] == ["can-match-empty"] and R.lints("ab", "g") == []
    with pytest.raises(R.Unsupported):
        R.parse("[a&&b]", "v")
    assert R.parse_literal("/a\\/[/]b/gi") == (r"a\/[/]b", "gi") and R.parse_literal("nope") is None
    assert R.literal("a/b", "g") == r"/a\/b/g" and R.literal("") == "/(?:)/" and R.constructor("\\d", "g") == 'new RegExp("\\\\d", "g")'
    kinds = [k for _, _, k, _ in R.explain(r"^(?<n>a+)|[^b-c]$", "")]
    assert kinds == ["alternatives", "sequence", "start", "capture", "repeat", "char", "sequence", "class", "range", "end"]
    assert R.toggle_flag("gu", "v") == "gv" and R.flags_of("yg") == "gy" and "Groups: 1, n" in R.summary("(?<n>a)", "g")


def test_replacement():
    assert R.replace_text(r"(?<y>\d+)-(\d+)", "g", "1-2 3-4", "$2/$<y>$$$&$3$<z>") == ("2/1$1-2$3 4/3$3-4$3", 2)
    assert R.replace_text("b", "", "abcb", "[$`|$']") == ("a[a|cb]cb", 1) and R.replace_text("(a)", "", "a", "$01$10$<x>") == ("aa0$<x>", 1)
    assert R.highlight("xay", "a", "g") == [("x", False), ("a", True), ("y", False)] and R.bench(["ab", "c"], "a", "gy") == [True, False]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a1\nb22"), (2, None), (3, "none"), (4, "a" * 60 + "b")], "id int, t string")
    got = [tuple(r)[:8] for r in R.matches(df, "id", "t", r"(\d)(\d)?", "g").collect()]
    assert got == [(1, "match", 0, 1, 2, "1", 1, 2), (1, "match", 1, 4, 6, "22", 2, 2)]
    assert [r["status"] for r in R.matches(df.where("id = 4"), "id", "t", "(a|aa)+$", "g", timeout=0.2).collect()] == ["timeout"]
    assert [r["status"] for r in R.matches(df.where("id = 4"), "id", "t", "a", "g", cap=2).collect()] == ["match", "match", "truncated"]
    r = df.where("id = 1").select(R.count(F.col("t"), r"\d").alias("c"), R.test(F.col("t"), r"^b", "m").alias("t1"), R.test(F.col("t"), r"^b").alias("t2"), R.replace(F.col("t"), r"\d", "g", "<$&>").alias("r"), R.count(F.col("t"), r"[^\s\W]").alias("w")).first()
    assert (r["c"], r["t1"], r["t2"], r["r"]["value"], r["r"]["n"], r["w"]) == (3, True, False, "a<1>\nb<2><2>", 3, 5)


def test_matches_are_not_capped_by_default(spark):
    df = spark.createDataFrame([(1, "a" * 1500)], "id long, t string")
    assert [r["status"] for r in R.matches(df, "id", "t", "a").collect()] == ["match"] * 1500


def test_both_paths_count_alike_also_with_back_references(spark):
    cases = [(r"^(?:(a)|b)\1$", "", ["b", "aa", "a", "ab"]), (r"(a)?\1b", "g", ["b", "aab", "aabb"]), (r"(?<q>['\"]).*?\k<q>", "g", ["'a' \"b\"", "'"]), (r"a+", "g", ["baaca"])]
    for source, flags, texts in cases:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [tuple(r) for r in df.select("t", R.count(F.col("t"), source, flags).alias("n"), R.test(F.col("t"), source, flags).alias("found")).collect()]
        assert got == [(t, len(R.run(source, "".join(set(flags) | {"g"}), t)[0]), bool(R.run(source, "", t)[0])) for t in texts]
