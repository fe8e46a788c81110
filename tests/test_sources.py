import csv
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen import streaming
from specimen.operators import jsondoc, profile
from specimen.sources import delimited as D
from specimen.sources import reports

TEXTS = {
    1: "name,age,city\nAda,36,London\nGrace,40,NYC\nAlan,41,Cambridge\nEdsger,50,Austin\n",
    2: 'name,note\n"Smith, John",hi\n"Doe, Jane",yo\n',
    3: 'quote\n"She said ""hi"""\n',
    4: "a,b\n1,2\n\n3,4\n",
    5: "a,b,c\n1,2,3\n4,5\n6,7,8,9\n",
    6: "1,2,3\n4,5,6\n7,8,9\n10,11,12\n",
    7: "a,b,c\n",
    8: 'a,b\n"open,2\n3,4\n',
    9: "﻿x;y;x\r\n1;2;3\r\n4;5;6\r\n7;8;9\r\n",
}


@given(st.lists(st.lists(st.text(alphabet='ab,"\n\r ;', max_size=5), min_size=2, max_size=4), min_size=1, max_size=5))
def test_tokenizer_reads_what_csv_writes(rows):
    text = io.StringIO()
    csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    got = D.parse(text.getvalue(), ",")
    assert got["rows"] == rows and got["faults"] == []


def test_rows():
    assert D.parse(TEXTS[2])["rows"][1] == ["Smith, John", "hi"] and D.parse(TEXTS[3], ",")["rows"][1] == ['She said "hi"']
    assert D.parse(TEXTS[8])["faults"] == [1] and D.parse(TEXTS[9])["delimiter"] == ";" and D.parse(TEXTS[9])["bom"]
    assert D.parse("a\tb\n1\t2\n")["delimiter"] == "\t" and D.parse("plain words\nand more\n")["delimiter"] == "" and D.parse(None)["rows"] == []
    assert D.delimiter_name("\t") == "tab"


def test_structure_and_findings(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, t string")
    rows = D.read_rows(df, "id", "t").cache()
    about = D.structure(rows).cache()
    s = {r["id"]: r for r in about.collect()}
    assert s[1]["has_header"] and (s[1]["n_rows"], s[1]["n_columns"]) == (4, 3)
    assert (s[4]["n_blank"], s[4]["n_ragged"]) == (1, 0) and s[5]["n_ragged"] == 2 and not s[6]["has_header"] and s[6]["n_rows"] == 4
    assert s[7]["has_header"] and s[7]["n_rows"] == 0 and s[8]["n_quote_faults"] == 1 and s[9]["bom"] and s[2]["assumed"]
    names = D.column_names(rows, about).cache()
    assert [r["name"] for r in names.where("id = 6").orderBy("col").collect()] == ["Column 1", "Column 2", "Column 3"]
    ids = {(r["subject"], r["id"]) for r in D.find(about, names).collect()}
    assert {("5", "structure-ds-rowshape"), ("8", "structure-ds-quotes"), ("4", "structure-ds-blankrows"), ("6", "structure-ds-noheader"), ("2", "structure-ds-headerassumed"), ("9", "structure-ds-bom"), ("9", "structure-ds-nonComma"), ("9", "headers-ds-duplicate"), ("3", "structure-ds-delimiter")} <= ids
    cells = D.data_cells(rows, about, names).where("id = 1")
    cols = {r["name"]: r["dominant_type"] for r in profile.columns(profile.frequencies(cells)).collect()}
    assert cols == {"name": "text", "age": "integer", "city": "text"}
    assert D.structure(rows, max_rows=2).where("id = 1").first()["truncated"]
    breaks = spark.createDataFrame([("a\nb",), ("a\r\nb",), ("a\rb",), ("a\r\nb\n",), ("a",)], "t string").select(D.line_breaks(F.col("t")).alias("b"))
    assert [r["b"] for r in breaks.collect()] == ["lf", "crlf", "cr", "mixed", "none"]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text(TEXTS[2])
    assert D.read_files(spark, str(tmp_path / "a.csv")).orderBy("row").collect()[1]["fields"] == ["Smith, John", "hi"]
    assert [r["fields"] for r in D.read_lines(spark, str(tmp_path / "a.csv")).orderBy("row").collect()] == [["name", "note"], ["Smith, John", "hi"], ["Doe, Jane", "yo"]]
    reports.write_texts(spark.createDataFrame([("x",), ("y",)], "t string").coalesce(1), "t", str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_reports(spark):
    df = spark.createDataFrame([(k, "a|b", None) for k in range(12)], "id int, t string, e string")
    p = profile.profile_table(df)
    text = reports.table_report(p)
    assert "12 rows, 3 columns" in text and "| id | integer |" in text and "No values (e)" in text
    assert '"n_rows": 12' in reports.table_json(p)
    n = jsondoc.nodes(spark.createDataFrame([(1, '[{"a":1},{"a":2},{"b":3}]')], "d long, t string"), "d", "t")
    assert "## Shapes" in reports.json_report(jsondoc.structure(n), jsondoc.shapes(n), jsondoc.findings(n))
    assert (reports.number(1234567), reports.number(1.5), reports.percent(0.5), reports.percent(1), reports.size(2048)) == ("1,234,567", "1.5", "50.0%", "100%", "2.0 KB")


def test_streams(spark, tmp_path):
    spark.createDataFrame([("1", "2026-01-01 00:00:10"), ("x", "2026-01-01 00:00:20"), ("2", "2026-01-01 00:10:00")], "raw string, at string").selectExpr("raw", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("raw string, at timestamp").parquet(str(tmp_path / "in"))
    q = streaming.windowed_classes(stream(), "raw", "at").writeStream.format("memory").queryName("classes").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert {(r["class"], r["n"]) for r in spark.table("classes").collect()} == {("integer", 1), ("text", 1)}
    seen = []
    q = streaming.profile_batches(stream(), ["raw"], lambda p, k: seen.extend(p.collect()), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert seen[0]["total"] == 3
    q = streaming.cell_classes(stream(), "raw").writeStream.format("memory").queryName("cells").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination(60)
    assert spark.table("cells").count() == 3
    with pytest.raises(ValueError):
        jsondoc.from_pointer("x")
