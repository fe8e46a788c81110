import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen.operators import jsondoc as J

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=4), v, max_size=4), max_leaves=20)


@given(VALUES)
def test_scan_and_render_agree_with_json(v):
    src = json.dumps(v, indent=1)
    found = J.scan(src)
    assert json.loads(J.render(src)) == v and json.loads(J.render(src, 2)) == v and json.loads(J.render(src, 2, True)) == v
    for x in found:
        at = v
        for p in J.from_pointer(x.pointer):
            at = at[int(p)] if isinstance(at, list) else at[p]
        assert json.loads(src[x.offset : x.offset + x.length]) == at


@given(st.text(alphabet='{}[]",:0-1e.\\ntrue u', max_size=14))
def test_scan_accepts_what_json_accepts(src):
    try:
        json.loads(src, parse_constant=lambda c: 1 / 0)
        good = True
    except (ValueError, ZeroDivisionError):
        good = False
    try:
        J.scan(src)
        assert good, src
    except J.JsonError:
        assert not good, src


def test_rendering_keeps_what_parsers_drop():
    assert J.render('{"a": 1.0, "a" : 10000000000000000000001}') == '{"a":1.0,"a":10000000000000000000001}'
    with pytest.raises(ValueError):
        J.render('{"a":1,"a":2}', 2, True)
    deep = "[" * 5000 + "]" * 5000
    assert J.render(deep) == deep
    assert J.accessor(["a", 0, "b c"]) == '$.a[0]["b c"]' and J.pointer(["a/b", 0, "~"]) == "/a~1b/0/~0" and J.from_pointer("/a~1b/0") == ["a/b", "0"]
    assert J.place("a\r\nbc", 4) == (2, 2) and J.preview("a\nb") == "a\\nb"


def test_tables(spark):
    docs = [(1, '[{"id":1,"name":"a","n":1},{"id":2,"name":"b","n":null},{"id":"3","fullName":"c","n":null}]'), (2, '{"a":1,"a":2,"id":1,"ID":2," k ":9007199254740993,"h​":"x​y","":1e400}'), (3, "{bad"), (4, None), (5, '{"e":[[],[],[]],"m":[1,"x"]}')]
    df = spark.createDataFrame(docs, "doc_id long, t string")
    n = J.nodes(df, "doc_id", "t").cache()
    assert {r["status"] for r in df.select(J.errors("t").alias("e")).select("e.*").collect()} == {"ok", "error", "empty"}
    e = df.where("doc_id = 3").select(J.errors("t").alias("e")).first()["e"]
    assert (e["line"], e["column"]) == (1, 2)
    s = {r["doc_id"]: r for r in J.structure(n).collect()}
    assert s[1]["n_object"] == 3 and s[1]["max_depth"] == 2 and s[5]["n_array"] == 5 and s[5]["largest_array"] == "/e"
    sh = [(r["keys"], r["n"], r["missing"], r["extra"]) for r in J.shapes(n).orderBy("rank").collect()]
    assert sh == [(["id", "n", "name"], 2, [], []), (["fullName", "id", "n"], 1, ["name"], ["fullName"])]
    assert [(r["kind"], r["n"], r["example"]) for r in J.field_types(n).orderBy("rank").collect()] == [("number", 2, "/0/id"), ("string", 1, "/2/id")]
    assert {(r["key"], r["present"], r["nulls"], r["missing"]) for r in J.nullability(n).collect()} == {("id", 3, 0, 0), ("n", 3, 2, 0), ("name", 2, 0, 1), ("fullName", 1, 0, 2)}
    ids = {(r["subject"], r["id"]) for r in J.findings(n).collect()}
    assert {("2", "dup-keys"), ("2", "keys-case"), ("2", "keys-whitespace"), ("2", "keys-empty"), ("2", "keys-hidden"), ("2", "strings-hidden"), ("2", "numbers-unsafe"), ("1", "shape-"), ("1", "types-field-"), ("1", "null-"), ("5", "empty-arrays"), ("5", "types-mixed-array")} == ids
    assert J.duplicate_keys(n).first()["n"] == 2 and J.search(n, "FULL").count() == 1 and J.search(n, "x", None).count() == 2
    assert df.select(J.pretty(F.col("t")).alias("p")).where("p is not null").count() == 3 and df.select(J.sorted_keys(F.col("t")).alias("p")).where("p is not null").count() == 2
    assert df.where("doc_id = 5").select(J.minified(F.col("t"))).first()[0] == docs[4][1]
