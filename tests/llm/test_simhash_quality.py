import random
import re
import statistics

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen.llm import quality, simhash
from specimen.llm.components import components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abÉé \n\t AZ.,", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(values, radius=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    vs = list(root)
    for i, a in enumerate(vs):
        for b in vs[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for v in vs:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = list({rng.getrandbits(12) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert {values[i] for i in tree.within(v, 2)} == {x for x in values if (x ^ v).bit_count() <= 2}


def test_links_lose_nothing_also_where_shards_are_hot(spark):
    rng = random.Random(3)
    values = {0}
    for _ in range(12):  # tight groups, chains, and many values that share three of the four blocks
        v = rng.getrandbits(64)
        for _ in range(8):
            values.add(v)
            for _ in range(rng.randint(1, 4)):
                v ^= 1 << rng.randrange(64)
    values |= {(0xABCDEF012345 << 16) | rng.getrandbits(16) for _ in range(60)}
    want = brute_components(sorted(values))
    df = spark.createDataFrame([(simhash._signed(v),) for v in sorted(values)], "fp long")
    for cap in (512, 4):
        groups = {}
        for node, root in components(simhash.links(df, cap)).collect():
            groups.setdefault(root, {root}).add(node)
        assert {frozenset(v & (1 << 64) - 1 for v in g) for g in groups.values()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 180)] + [(7, k) for k in range(200, 260)] + [(5, 5), (7, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(101, 181)}, **{k: 7 for k in range(200, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_and_deduplicate(spark, docs_of):
    body = " ".join(f"word{k} and{k}" for k in range(400))
    rows = [(5, body), (3, body + " tail"), (9, body.replace("word7 ", "other7 ")), (None, body), (1, None), (4, ""), (2, "  \n"), (8, "something else entirely here"), (8, "something else entirely here")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert {(5, 3), (3, 3), (9, 3), (None, 3), (1, 1), (4, 1), (2, 1), (8, 8)} == got
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in simhash.deduplicate(docs_of(rows)).collect())
    assert kept == [(False, 1), (False, 3), (False, 8)]  # a row without an id is the last of its group to stay
    assert simhash.deduplicate(docs_of([(None, body), (None, body + " tail")])).count() == 1
    assert simhash.deduplicate(docs_of(rows)).columns == docs_of(rows).columns
    assert simhash.near_duplicates(docs_of([])).collect() == []


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {w: wins.count(w) for w in set(wins)}
    covered = {j for i, w in enumerate(wins) if seen[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs_of):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a b", "a b c a b c", "x\nx\n\n x\nx", "é ü 👍 # | <"]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "\n", "\t", "\x0b", "#", "é", "\xa0"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in quality.measure(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        want = brute_counts(t)
        assert tuple(got[k][c] for c in quality.BASE) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[k]["base_failed"] == failed and not (failed and got[k]["kept"])


def test_quantiles_of_sketches_are_close_and_merge(spark):
    rng = random.Random(6)
    data = [(k, rng.choice(["a", None]), rng.choice(["x", "y", None]), rng.randint(1, 1000)) for k in range(3000)]
    rows = spark.createDataFrame(data, "doc_id long, lang string, source string, v long")
    zero = F.lit(0).cast("long")
    m = F.struct(F.lit(1000).cast("long").alias("n_words"), F.lit(1000).cast("long").alias("word_chars"), F.col("v").alias("n_symbols"), zero.alias("n_dup_lines"), zero.alias("n_repeat_words"), zero.alias("n_lines"), zero.alias("n_bangs"), zero.alias("n_bars"))
    sketch = quality.sketches(rows.withColumn("__sp_m", m))
    for by, groups in ((["lang"], [("a",), (None,)]), (["lang", "source"], [("a", "x"), (None, None)])):
        got = {tuple(r[c] for c in by): r for r in quality._quantiles(sketch, by).collect()}
        for g in groups:
            own = sorted(d[3] / 1000 for d in data if d[1 : 1 + len(g)] == g)
            q50, q75 = own[int(len(own) * 0.5)], own[int(len(own) * 0.75)]
            fence = q50 + quality.REACH * (q75 - q50)
            assert abs(got[g]["fence"]["symbols_per_char"] - fence) < 0.1 * fence and got[g]["docs"] == len(own)
    assert statistics.median([d[3] for d in data]) > 0


def test_rules_reject_junk_and_keep_clean(docs_of):
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(120)) + ". What fun!\nAnother line."
    clean = [(k, prose(), rng.choice(["en", None]), rng.choice(["s", None, "rare"]) if k < 3 else "s") for k in range(150)]
    junk = [(1000 + k, prose().replace(" ", "### "), "en", "s") for k in range(8)] + [(1100, prose().replace(" ", "!! "), "en", "s"), (1101, None), (1102, "too short")]
    kept = {r["doc_id"] for r in quality.apply_rules(docs_of(clean + junk)).collect()}
    assert kept == {r[0] for r in clean}
    assert quality.apply_rules(docs_of([])).collect() == [] and quality.measure(docs_of([])).collect() == []


def test_look_alikes_are_caught_and_clean_texts_are_not(docs_of):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: [word() for _ in range(n)]

    def edited(words, k):
        out = list(words)
        for at in rng.sample(range(len(words)), k):
            out[at] = word()
        return out

    passage = text(60)
    clean = [(k, " ".join(passage + text(150) if k % 3 == 0 else text(200))) for k in range(80)]  # many share a passage
    base = text(250)
    copies = [(1000 + k, " ".join(edited(base, 3))) for k in range(30)]
    rows = clean + [(500, " ".join(base)), *copies]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    assert all(len(sets[500] & sets[k]) / len(sets[500] | sets[k]) >= 0.8 for k, _ in copies)
    for cap in (simhash.SHARD_CAP, 8):
        links = simhash.look_links(simhash.looked(docs_of(rows)), shard_cap=cap)
        found = simhash.near_duplicates(docs_of(rows), extra=links).collect()
        group = {r["doc_id"]: r["component_id"] for r in found}
        assert all(group[k] == 500 for k, _ in copies) and all(group[k] == k for k, _ in clean)
    assert {r["doc_id"] for r in simhash.deduplicate(docs_of(rows)).collect()} == {k for k, _ in clean} | {500}


def test_minhash_estimates_similarity():
    rng = random.Random(10)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = [w if rng.random() > 0.03 else "x" + w for w in words]
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (words, other))
    same = sum(x == y for x, y in zip(simhash.look(" ".join(words))[1], simhash.look(" ".join(other))[1], strict=True)) / simhash.LOOK_VALUES
    assert abs(same - len(a & b) / len(a | b)) < 0.12
    assert simhash.look(None)[2] == [] and len(simhash.look("one two")[2]) == simhash.LOOK_BANDS


def test_very_long_texts_and_clashing_columns(spark):
    from collections import Counter

    rng = random.Random(12)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(40)) for _ in range(40_000))
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    words = text.split()
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(wins)
    want = len({j for i, w in enumerate(wins) if seen[w] > 1 for j in range(i, i + 3)})
    df = spark.createDataFrame([(1, text, "en", "s", 1, 2, 3)], "doc_id long, text string, lang string, source string, fp int, n_words int, kept int")
    r = quality.measure(df).first()
    assert (r["n_words"], r["n_repeat_words"]) == (40_000, want)
    assert quality.apply_rules(df).columns == df.columns == simhash.deduplicate(df).columns


def signature(differs):
    sig = np.zeros(simhash.LOOK_VALUES, np.uint8)
    sig[list(differs)] = 1
    return sig.tobytes()


def test_a_linked_text_still_links_later_ones():
    held = [(1, 0, signature(range(25))), (2, 0, signature([])), (3, 0, signature(range(40, 65))), (4, 0, signature(range(128)))]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 4), *[pa.array(c, k) for c, k in zip(zip(*held, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)], pa.array([[1]] * len(held))], ["g", "fp", "fp5", "sig", "keys"])
    links = {frozenset((r["a"], r["b"])) for out in simhash._look_links([batch]) for r in out.to_pylist()}
    assert links == {frozenset((1, 2)), frozenset((2, 3))}  # 1 and 3 are alike only through 2


def test_shards_link_just_what_all_pairs_link():
    rng = random.Random(14)
    held = []
    for k in range(120):
        base = [(k % 4) * 30 + j for j in range(28)]
        held.append((k, rng.getrandbits(6), signature(rng.sample(base, rng.randint(6, 26)))))
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 120), *[pa.array(c, k) for c, k in zip(zip(*held, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)], pa.array([[1]] * len(held))], ["g", "fp", "fp5", "sig", "keys"])

    def groups(links):
        root = {h[0]: h[0] for h in held}
        for a, b in links:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    alike = lambda a, b: (a[1] ^ b[1]).bit_count() <= simhash.LOOK_RADIUS and sum(x == y for x, y in zip(a[2], b[2], strict=True)) >= simhash.LOOK_LEAST * simhash.LOOK_VALUES
    want = [(a[0], b[0]) for i, a in enumerate(held) for b in held[:i] if alike(a, b)]
    got = [(r["a"], r["b"]) for out in simhash._look_links([batch]) for r in out.to_pylist()]
    assert groups(got) == groups(want) and len(got) < len(held)


def test_hot_shards_drop_no_pair_that_shares_one_band(spark):
    rng = random.Random(15)
    keys = lambda k: [99, *(1000 + 10 * k + j for j in range(1, simhash.LOOK_BANDS))]
    rows = [(k, 0, bytearray(rng.randrange(256) for _ in range(simhash.LOOK_VALUES)), keys(k)) for k in range(30)]
    most = simhash.LOOK_BLOCKS - 1
    pairs = [set(rng.sample(range(simhash.LOOK_VALUES), most)) for _ in range(8)] + [set(range(0, 4 * most, 4))]
    for k, differ in enumerate(pairs):  # as many values differ as may, wherever they are
        rows.append((100 + k, 0, bytearray(v ^ (j in differ) for j, v in enumerate(rows[k][2])), keys(100 + k)))
    df = spark.createDataFrame([(k, k, f, bytes(sig), own) for k, f, sig, own in rows], "doc_id long, fp long, fp5 long, sig binary, keys array<long>")
    for cap, most in ((simhash.SHARD_CAP, simhash.LOOK_CAP), (8, simhash.LOOK_CAP), (8, 4)):
        found = {frozenset((r["a"], r["b"])) for r in simhash.look_links(df, shard_cap=cap, task_cap=most).collect()}
        assert found == {frozenset((k, 100 + k)) for k in range(len(pairs))}


def test_one_rule_links_at_every_shard_size(spark):
    """Alike by MinHash alone is not enough: texts without a common band stay apart, in cold, hot and cut shards."""
    rng = random.Random(16)
    rows = []
    for k in range(40):
        sig = bytearray(signature(rng.sample(range(60), rng.randint(4, 30))))
        rows.append((k, rng.getrandbits(8), bytes(sig), sorted(rng.sample(range(12), simhash.LOOK_BANDS // 2))))
    df = spark.createDataFrame([(k, k, f, sig, [(b << 8) + j for j, b in enumerate(own)]) for k, f, sig, own in rows], "row long, fp long, fp5 long, sig binary, keys array<long>")
    keyed = {r["fp"]: {(j, x) for j, x in enumerate(r["keys"])} for r in df.collect()}
    alike = lambda a, b: bool(keyed[a[0]] & keyed[b[0]]) and (a[1] ^ b[1]).bit_count() <= simhash.LOOK_RADIUS and sum(x == y for x, y in zip(a[2], b[2], strict=True)) >= simhash.LOOK_LEAST * simhash.LOOK_VALUES
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if alike(a, b)}

    def groups(links):
        root = {r[0]: r[0] for r in rows}
        for a, b in links:
            old, new = root[a], root[b]
            root = {k: new if v == old else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    assert want
    for cap, most in ((simhash.SHARD_CAP, simhash.LOOK_CAP), (3, simhash.LOOK_CAP), (3, 4)):
        assert groups((r["a"], r["b"]) for r in simhash.look_links(df, shard_cap=cap, task_cap=most).collect()) == groups(want)


def test_rows_are_dropped_and_not_ids(docs_of):
    body = " ".join(f"word{k} and{k}" for k in range(400))
    other, third = " ".join(f"other{k} than{k}" for k in range(300)), " ".join(f"third{k} text{k}" for k in range(300))
    stay = lambda rows: sorted((r["doc_id"], r["text"], r["source"]) for r in simhash.deduplicate(docs_of(rows)).collect())
    assert stay([(8, body), (8, other), (9, third)]) == sorted([(8, body, "s"), (8, other, "s"), (9, third, "s")])
    assert stay([(3, body), (8, body), (8, other)]) == [(3, body, "s"), (8, other, "s")]
    assert stay([(8, body, "en", "z"), (8, body, "en", "a"), (8, body, "en", "m")]) == [(8, body, "a")]
    assert [r["doc_id"] for r in simhash.deduplicate(docs_of([(7, None), (7, None), (7, "")])).collect()] == [7]


def test_a_sieve_loses_nothing_at_any_size(spark):
    from specimen.llm import _shared

    for n in (0, 5, 3000):
        some = spark.range(n).select(F.xxhash64("id").alias("h"))
        marked = _shared.sieve(some)(spark.range(6000).select("id", F.xxhash64("id").alias("h"), F.lit(1).alias("mask")), "h")
        passed = {r["id"] for r in marked.where("__sp_pass").collect()}
        assert marked.count() == 6000 and set(range(n)) <= passed and len(passed) - n < 600
