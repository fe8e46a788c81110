import base64
import os
import hashlib

import pytest

import __spark_entry__
import corpus_pipeline
from specimen.llm import queries, warc


def test_url_keys():
    assert warc.url_key("https://A.example.com:443/x?y=1#z") == "com,example,a)/x?y=1"
    assert warc.url_key("http://example.org:8080") == "org,example:8080)/"
    assert warc.url_key(None) == warc.url_key(" ") == "-" and warc.url_key("no host") == "no host" and warc.url_key("http://[bad") == "http://[bad"


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_warc_round_trip(spark, tmp_path):
    rows = [(k, f"https://h{k % 5}.example.com/p{k}?a\r\nb", f"<p>é {k % 7}\r\n\r\nWARC/1.1</p>" * (1 + k % 3)) for k in range(3, 90)]
    rows += [(1, None, None), (2, "http://x.example/", ""), (7, rows[4][1], rows[4][2]), (None, "http://n.example/", "<p>only</p>"), (None, "http://m.example/", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, length string")
    low = {}
    for i, _, h in rows:
        if i is not None:
            low[h or ""] = min(i, low.get(h or "", i))
    want = []
    for i, _, h in rows:
        revisit = (h or "") in low and low[h or ""] != i
        want.append((-1 if i is None else i, len((h or "").encode()), b32(h), "revisit" if revisit else "response", low[h or ""] if revisit else None))
    got = [(-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = warc.round_trip(pages, min_bytes=1).where("payload_bytes = 0").collect()
    assert len(small) == 3 and {r["record_type"] for r in small} == {"response"}
    archives, index = f"file://{tmp_path}/warc", f"file://{tmp_path}/cdx"
    warc.write(pages, archives)
    warc.build_index(spark, archives, index)
    found = warc.CaptureIndex(warc.directory(spark, index))
    for i, u, h in rows[:30]:
        (hit,) = {c["offset"]: c for c in found.find(u) if c["page_id"] == i and c["payload_digest"] == b32(h)}.values() if i != 7 else [next(c for c in found.find(u) if c["page_id"] == 7)]
        if hit["record_type"] == "response":
            assert found.payload(hit) == h.encode()
    assert found.find("http://absent.example/") == []
    assert warc.round_trip(pages.where("false")).collect() == []
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontaminated", "sanitised", "packed"]


def test_pipeline_stages(spark, tmp_path, docs_of):
    import random

    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    item = text(40)
    clean = [(k, text(120), "en", "s") for k in range(60)]
    rows = [*clean, (100, clean[5][1], "en", "s"), (101, text(60) + " " + item, "en", "s"), (102, text(80) + " reach me at me@mail.example.com", "en", "s"), (103, "short", "en", "s"), (104, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    alive = [set(range(60)) | {100, 101, 102}, set(range(60)) | {101, 102}, set(range(60)) | {102}, set(range(60)) | {102}]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, alive, strict=False):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in docs.collect()} == ids, name
    assert "me@mail" not in docs.where("doc_id = 102").first()["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == alive[-1] and all(r["offset"] + r["length"] <= 4096 for r in packed)


def test_pipeline_of_empty_tables_and_scratch_space(spark, tmp_path):
    from specimen.llm import _shared

    rows = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    with _shared.temporary(spark) as lasts:
        gone = _shared.keep(spark.range(3), "gone")
        stays = lasts(_shared.keep(spark.range(4), "stays"))
    assert stays.count() == 4 and not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))
    _shared.clean_up(spark)
    assert not os.path.exists(stays.inputFiles()[0].removeprefix("file://"))
