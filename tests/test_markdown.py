import pytest
from pyspark.sql import functions as F

from specimen.operators import markdown as M

DOC = """# Title *here*

Some **bold**, `code` and [a link](https://x.example/a_(b) "t"), <https://y.example>, ![alt](i.png).
Second line  
third

- one
- two
  continued
  1. deep
  2. deeper
- [x] done
- [ ] open

> quoted
> more

```py
x = 1 < 2
```

| a | b |
|:--|--:|
| 1 | two words |
| 3 |

***

See [ref] and [text][ref].

[ref]: https://z.example
"""


def out(text, to="plain", **k):
    return M.transform(text, to, **k)["output"]


def test_plain():
    got = out(DOC)
    assert got.startswith("Title here\n══════════\n\nSome bold, `code` and a link (https://x.example/a_(b)), https://y.example, alt (i.png).\nSecond line\nthird\n\n")
    assert "• one\n• two\n  continued\n  1. deep\n  2. deeper\n☑ done\n☐ open" in got and "> quoted\n> more" in got and "\nx = 1 < 2\n" in got
    assert "| a   |         b |\n|-----|-----------|\n| 1   | two words |\n| 3   |           |" in got and "─" * 24 in got and "See ref (https://z.example) and text (https://z.example)." in got


def test_other_destinations():
    assert "“quoted\nmore”" in out(DOC, "linkedin") and "a 1\nb: two words\n\na 3\nb:" in out(DOC, "linkedin") and "```\nx = 1 < 2\n```" in out(DOC, "slack")
    rich = out(DOC, "rich")
    assert '<h1>Title <em>here</em></h1>' in rich and "<pre><code>x = 1 &lt; 2</code></pre>" in rich and '<a href="https://x.example/a_(b)">a link</a>' in rich and '<th style="text-align:left">a</th>' in rich and "<li>two\ncontinued<ol>" in rich
    red = out(DOC, "reddit")
    assert red.startswith("# Title *here*") and "[alt](i.png)" in red and "- ☑ done" in red and "|:---|---:|" in red
    with pytest.raises(ValueError):
        out("x", "nowhere")


@pytest.mark.parametrize("text,html", [("***a** b*", "<p>***a** b*</p>"), ("a_b_c", "<p>a_b_c</p>"), ("\\*x\\*", "<p>*x*</p>"), ("**a *b* c**", "<p><strong>a <em>b</em> c</strong></p>"), ("~~x~~", "<p><del>x</del></p>"), ("[x](javascript:alert)", "<p>x</p>"), ("Title\n===", "<h1>Title</h1>"), ("a\n---", "<h2>a</h2>"), ("    code", "<pre><code>code</code></pre>"), ("3. x\n4. y", '<ol start="3"><li>x</li><li>y</li></ol>'), ("- a\n\n- b", "<ul><li><p>a</p></li><li><p>b</p></li></ul>"), ("&amp; <b>", "<p>&amp; &lt;b&gt;</p>"), ("``a`b``", "<p><code>a`b</code></p>"), ("[no link]", "<p>[no link]</p>"), ("www.x.example.", '<p><a href="http://www.x.example">www.x.example</a>.</p>'), ("", ""), ("1) a", "<ol><li>a</li></ol>"), ("***both***", "<p><em><strong>both</strong></em></p>")])
def test_inline_and_blocks(text, html):
    assert out(text, "rich") == html


def test_tables_and_width():
    assert M.display_width("日本") == 4 and M.display_width("é") == 1 and M.display_width("🇺🇸") == 2 and M.display_width("👨‍👩‍👧") == 2 and M.pad("x", 4, "center") == " x  "
    wide = "| k | v |\n|---|---|\n| a | " + "word " * 40 + "|\n"
    got = out(wide)
    assert max(map(M.display_width, got.split("\n"))) <= 72 and got.count("\n") > 3
    many = "|" + "a|" * 8 + "\n|" + "---|" * 8 + "\n|" + "1|" * 8 + "\n"
    assert M.transform(many)["tables"] == [(8, 1, "records")] and out(many).startswith("a 1\na: 1")
    assert M.layout(["a"], [["b"]], "linkedin") == "records" and M.layout(["a"], [["b"]], "plain", "records") == "records"
    assert all(M.display_width(x) <= 5 for x in M._wrap("supercalifragilistic 日本語日本語", 5))


def test_report_and_column(spark):
    assert M.transform("plain words")["status"] == "preserved" and M.transform("# h")["status"] == "adapted" and M.transform("**b**")["status"] == "compromised" and M.transform("**b**", "rich")["status"] == "preserved"
    df = spark.createDataFrame([(DOC,), (None,)], "t string")
    got = df.select(M.transform_column(F.col("t"), "slack").alias("m")).collect()
    assert got[0]["m"]["tables"][0]["representation"] == "aligned" and {f["category"] for f in got[0]["m"]["findings"]} >= {"tables", "links", "tasks"} and got[1]["m"]["output"] == ""
