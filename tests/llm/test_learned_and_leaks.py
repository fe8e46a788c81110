import random
import zlib

import numpy as np

from specimen.llm import decontam, langid, toxicity


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


LANGS = {"en": ["the", "ing", "and", "ou", "sh"], "de": ["sch", "ein", "ung", "ü", "ver"], "fr": ["eau", "é", "oi", "le", "tion"], "es": ["ción", "ado", "ll", "ñ", "os"], "xx": ["qo", "zk", "wy", "vx", "jj"]}


def test_languages(docs_of):
    rng = random.Random(1)
    rows = [(k, speech(rng, LANGS[lang], 30), lang) for k, lang in enumerate(list(LANGS) * 60)]
    more = [(1000, None, "en"), (1001, "123 456", "en"), (1002, "", None), (None, rows[0][1], None), (1003, rows[1][1].upper(), None), (1004, "\u00bd \u00b2", "en"), (1005, "\u2167", "de"), (1006, "\u2460 7", None), (1007, speech(rng, LANGS["de"], 60_000), None)]
    got = langid.identify(docs_of(rows + more)).collect()
    assert len(got) == len(rows) + len(more)
    by = {r["doc_id"]: r for r in got}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(by[k]["held_out"] == (k in held) for k, *_ in rows)
    assert sum(by[k]["lang_pred"] == rows[k][2] for k in held) / len(held) > 0.95
    for k in (1000, 1001, 1002):
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert by[None]["lang_pred"] == "en" and by[None]["held_out"] and by[1003]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got)
    for k in (1004, 1005, 1006):  # number signs are no letters
        assert (by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0)
    assert by[1007]["lang_pred"] == "de"  # a very long text
    assert {r["lang_pred"] for r in langid.identify(docs_of([(1, "some text", None)])).collect()} == {"und"}
    assert langid.identify(docs_of([])).collect() == []


def test_family_first():
    rng = random.Random(2)
    model = langid.Model([(speech(rng, LANGS[x], 40), x) for x in LANGS for _ in range(30)])
    assert model.families == {"=xx": ["xx"], "germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert len(model.pairs["romance"]) == 1 and not model.pairs["=xx"]


def test_toxicity(spark, docs_of):
    rng = random.Random(3)
    clean = lambda: speech(rng, LANGS["en"], 60)
    insult = lambda: rng.choice(["moron", "scumbag", "trashy", "vilestuff"])
    rows = [(k, " ".join([clean(), *[f"{insult()} {clean()}" for _ in range(k % 4 + 1)]]) if k % 3 == 0 else clean()) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    more = [(9000, None), (9001, ""), (None, "moron " + clean())]
    got = toxicity.severity(docs_of(rows + more), labels).collect()
    assert len(got) == len(rows) + 3
    by = {r["doc_id"]: r for r in got}
    unseen = range(300, 600)
    assert sum(by[k]["toxic"] == (k % 3 == 0) for k in unseen) / 300 > 0.97
    assert all(0 <= r["severity"] <= toxicity.GRADES and 0 <= r["grade"] <= toxicity.GRADES for r in got)
    mild, harsh = ([by[k]["severity"] for k in unseen if k % 3 == 0 and k % 4 == m] for m in (0, 3))
    assert np.mean(harsh) > np.mean(mild)  # more insults, more severe
    assert not by[9000]["toxic"] and not by[9001]["toxic"]
    model = toxicity.fit(docs_of(rows), labels)
    assert list(model.cuts) == sorted(model.cuts)
    none = toxicity.severity(docs_of(rows[:3]), labels.where("false")).collect()
    assert [(r["severity"], r["toxic"]) for r in none] == [(0.0, False)] * 3
    assert toxicity.severity(docs_of([]), labels).collect() == []
    bad = toxicity.severity(docs_of([*rows[:3], (9, None), (10, "")]), labels.where("toxic = 1")).collect()
    assert len(bad) == 5 and {(r["severity"], r["toxic"]) for r in bad} == {(0.0, False)}  # one kind of label tells nothing


def test_toxicity_of_repeated_ids_clashing_names_and_long_texts(spark):
    rng = random.Random(13)
    clean = lambda n=60: speech(rng, LANGS["en"], n)
    rows = [(k, f"{clean()} moron {clean()} moron" if k % 2 else clean()) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2, "x", 1) for k in range(100)], "doc_id long, toxic int, _id string, _y int")
    full = [(k, t, "u", "v", 3, True) for k, t in rows + rows[:50] * 20 + [(500, clean(60_000) + " moron moron"), (501, clean(60_000))]]
    docs = spark.createDataFrame(full, "doc_id long, text string, _id string, t string, _y int, severity boolean")
    got = toxicity.severity(docs, labels).collect()
    assert len(got) == len(full)
    assert sum(r["toxic"] == bool(r["doc_id"] % 2) for r in got if r["doc_id"] < 500) > 0.97 * 1200
    assert {r["doc_id"] for r in got if r["doc_id"] >= 500} == {500, 501}


def brute_logit(model, text):
    return sum(model.weights.get(f, 0.0) for f in toxicity.features(text))


def test_severity_is_that_of_a_cumulative_link(docs_of):
    rng = random.Random(14)
    sample = [(" ".join([speech(rng, LANGS["en"], 30), *["moron"] * (k % 4), *["scum"] * (k % 8 // 4)]), int(k % 4 > 0)) for k in range(400)]
    model = toxicity.Model(sample)
    for text, _ in sample[:40]:
        above = [1 / (1 + np.exp(c - brute_logit(model, text))) for c in model.cuts]
        severity, grade, p = model.score(text)
        assert abs(severity - sum(above)) < 1e-9 and abs(p - above[0]) < 1e-9 and above == sorted(above, reverse=True)
        chance = -np.diff([1.0, *above, 0.0])
        assert chance[grade] == max(chance)


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y and x >= 0 else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(r) for r in h)


def test_alignment_equals_the_textbook():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randint(-1, 4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        a = [max(0, x) for x in a]
        score, s, e = decontam.align(np.array(a), np.array(b))
        assert score == brute_align(a, b)
        if score:
            assert brute_align(a, b[s:e]) == score


def test_leaks_copied_and_edited(spark, docs_of):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) if rng.random() < 0.6 else rng.choice(["the", "of", "and", "in"]) for _ in range(n))
    items = [(k, text(40)) for k in range(12)] + [(50, None), (51, ""), (52, "quixotic zebra")]

    def edited(t):
        w = t.split()
        for k in range(5, len(w), 7):
            w[k] = "changed"
        del w[20]
        return " ".join(w)

    rows = [(k, text(200)) for k in range(40)]
    rows += [(100, f"{text(80)} {items[0][1].upper()} {text(80)}"), (101, f"{text(80)} {edited(items[1][1])} {text(50)}"), (102, " ".join(items[2][1].split()[:8]) + text(50)), (103, text(20) + " Quixotic zebra, " + text(9))]
    rows += [(200 + k, f"{text(30)} {items[3][1]}") for k in range(60)] + [(None, items[4][1]), (300, None), (301, ""), (100, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK, 250):
        got = decontam.find(docs_of(rows), bench, block=block).collect()
        found = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["item_id"]) for r in got)
        assert found == sorted([((False, 100), 0), ((False, 100), 0), ((False, 101), 1), ((False, 103), 52), ((True, 0), 4), *[((False, 200 + k), 3) for k in range(60)]])
    left = decontam.decontaminate(docs_of(rows), bench)
    assert left.columns == docs_of(rows).columns
    assert {r["doc_id"] for r in left.collect()} == {*range(40), 102, 300, 301}
    assert decontam.decontaminate(docs_of(rows), bench.where("false")).count() == len(rows)
    assert decontam.find(docs_of([]), bench).collect() == []


def test_leaks_that_are_frequent_and_partial_or_edited(spark, docs_of):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(n))
    items = [(k, text(60)) for k in range(2)]
    part = " ".join(items[0][1].split()[:40])
    edited = " ".join("changed" if k % 12 == 6 else w for k, w in enumerate(items[1][1].split()))
    rows = [(k, text(80)) for k in range(40)] + [(100 + k, f"{text(30)} {part} {text(30)}") for k in range(50)] + [(200 + k, f"{text(30)} {edited} {text(30)}") for k in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find(docs_of(rows), bench).collect()}
    assert found == {(100 + k, 0) for k in range(50)} | {(200 + k, 1) for k in range(50)}
    assert {r["doc_id"] for r in decontam.decontaminate(docs_of(rows), bench).collect()} == set(range(40))


def test_the_bound_is_never_below_the_alignment():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (np.array([rng.randint(-1, 6) for _ in range(rng.randint(1, 30))]) for _ in range(2))
        a = np.maximum(a, 0)
        assert decontam.bound(np.unique(a), b) >= decontam.align(a, b)[0]


def test_leaks_are_those_of_an_exhaustive_alignment(spark, docs_of):
    """Every item against every whole document by the textbook's table; a leak must also hold the seeds that the method asks for."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, text(rng.randint(4, 24))) for k in range(10)] + [(20, ["solo"]), (21, ["two", "words"]), (22, ["w1"])]

    def edited(w):
        return [x if rng.random() > 0.15 else rng.choice(vocabulary) for x in w if rng.random() > 0.08]

    rows = [(k, text(rng.randint(0, 70))) for k in range(25)]
    rows += [(100 + k, text(rng.randint(0, 30)) + edited(items[k % 10][1]) + text(rng.randint(0, 30))) for k in range(40)] + [(200, ["a", "solo"]), (201, ["two", "x", "words"]), (202, ["two", "words"])]
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    number = {w: k for k, w in enumerate(sorted({w for _, t in items + rows for w in t}))}
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find(docs_of([(k, " ".join(t)) for k, t in rows]), bench).collect()}
    for d, t in rows:
        for k, item in items:
            best = brute_align([number[w] for w in item], [number[w] for w in t]) / (2 * len(item)) if t else 0
            n = min(decontam.N, len(item))
            runs = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
            seeds = len(runs(item) & runs(t))
            need = min(decontam.MIN_SEEDS, len(runs(item)))
            if (d, k) in got:
                assert best >= decontam.SCORE and seeds >= need and got[d, k]["score"] <= best
            elif best >= decontam.SCORE and seeds >= need:  # the seeds of the best alignment may lie apart from it
                a = [i for i in range(len(t) - n + 1) if tuple(t[i : i + n]) in runs(item)]
                assert max(b - a for a, b in zip(a, a[1:], strict=False)) > 2 * len(item)
    assert {(200, 20), (202, 21)} <= set(got) and (201, 21) not in got and sum(d >= 100 for d, _ in got) > 25


def test_short_items_cost_no_scan_of_all_seeds():
    rng = random.Random(9)
    items = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(60))) for k in range(400)]
    bench = decontam.Benchmark([*items, (1000, "quixotic zebra")])
    assert [n for n, *_ in bench.index] == [2, 3] and len(bench.index[0][1]) == 1
    assert [x[0] for x in bench.leaks("a quixotic zebra and " + items[7][1] + " word" * 50_000)] == [7, 1000]


def test_clashing_names_and_very_long_documents(spark):
    rng = random.Random(10)
    item = " ".join(f"w{rng.randrange(5000)}" for _ in range(40))
    long = " ".join(f"x{rng.randrange(5000)}" for _ in range(60_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}", 1, 2, 3), (2, long, 4, 5, 6), (3, None, 7, 8, 9)], "doc_id long, text string, k int, t int, item_id int")
    bench = spark.createDataFrame([(5, item, 1, 2)], "item_id long, text string, k int, t int")
    [r] = decontam.find(docs, bench).collect()
    assert (r["doc_id"], r["item_id"], r["score"], r["first_word"]) == (1, 5, 1.0, 60_000)
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and {x["k"] for x in left.collect()} == {4, 7}
