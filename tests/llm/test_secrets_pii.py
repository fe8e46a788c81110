import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specimen.llm import pii, secrets


def brute_secrets(text):
    pats = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    out = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(pats) for m in p.finditer(text or "") if ok(m)]
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


SECRET_BITS = ["token", "Token=", "secret: ", "api_key", "APIKEY", "pass", "password", "paßword", "=", ":", " ", '"', "'", "abc123", "0123456789abcdef", "AKIA", "ABCDEFGHIJ1234567890", "é", "\n", "ſecret=abcdefgh", "x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SECRET_BITS), max_size=14).map("".join))
def test_base_secrets(text):
    assert [s[:3] for s in secrets.base_spans(text)] == brute_secrets(text)


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def brute_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    pats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m[0].split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in pats for m in re.finditer(p, text or "") if ok(m)]


PII_BITS = ["a", "b.c", "@", "x.y", ".com", "-", "1.2.3.4", "256.1.1.1", ".", "001", "4366826422043230", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "  ", "+1 (886) 555-7964", "+", "(", "12", "٣", "é", "\n", "99999999999999999999", "%"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PII_BITS), max_size=14).map("".join))
def test_base_pii(text):
    assert pii.base_spans(text) == brute_pii(text)


def test_hostile_texts_end_soon():
    assert pii.base_spans("a" * 200_000 + " @ " + "1" * 200_000 + "@") == []
    assert secrets.base_spans("secret" + " " * 200_000) == []


def test_alergia_merges_a_loop():
    rng = random.Random(1)
    loop = ["ab" * next(n for n in range(1, 99) if rng.random() < 0.3) for _ in range(800)]
    a = secrets.Automaton.infer(loop)
    live, stack = set(), [0]
    while stack:
        x = stack.pop()
        if x not in live:
            live.add(x)
            stack += [t[0] for t in a.next[x].values()]
    assert len(live) < 6 and sum(a.visits[x] for x in live) > 0
    assert a.likelihood("abababababababab") > a.likelihood("abbbabababababab")


def test_secret_query(docs_of):
    rng = random.Random(2)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    every = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = lambda: " ".join(pick("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 14)) for _ in range(40))
    rows = [(k, f'{words()} api_key = "{pick(every, 32)}" {words()}') for k in range(120)] + [(200 + k, f"{words()} {pick(every, 32)} {words()}") for k in range(20)] + [(300 + k, words()) for k in range(60)]
    rows += [(None, None), (1, "password=hunter22"), (400, "")]
    got = secrets.find(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((d is None, d or 0), ",".join(f"{k}:{s}:{e}" for k, s, e in brute_secrets(t))) for d, t in rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["base_sha256"]) for r in got) == sorted((k, hashlib.sha256(s.encode()).hexdigest()) for k, s in want)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert sum(by[200 + k][0]["n_grammar"] for k in range(20)) >= 18  # bare credentials of the learned format
    assert not any(by[300 + k][0]["spans"] for k in range(60))
    assert by[1][1]["n_assign"] + by[1][0]["n_assign"] == 2 and by[400][0]["spans"] == ""
    assert secrets.find(docs_of([])).collect() == []


def test_pii_terms_that_reveal_an_entity(docs_of):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{fill(20)} the Zanzibari {word()} wrote from zed@mail.example.com {word()} and {word()} the {fill(20)}") for k in range(6)]
    rows += [(50 + k, f"{fill(30)} the {fill(10)} one{k}@mail.example.com the {fill(10)}") for k in range(40)]
    copied = f"{fill(10)} Quixotically same@mail.example.com {fill(10)}"
    rows += [(200 + k, copied) for k in range(10)] + [(300, None), (301, ""), (None, "+1 (886) 555-7964"), (300, "x")]
    got = pii.find(docs_of(rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 6:
            terms = [x.split(":") for x in r["spans"].split(",") if x.startswith("term")]
            assert "Zanzibari" in {text[r["doc_id"]][int(s) : int(e)] for _, s, e in terms}
            assert "the" not in {text[r["doc_id"]][int(s) : int(e)] for _, s, e in terms}
        else:
            assert r["n_term"] == 0  # one mention, or copies of one passage, are no evidence
        if r["doc_id"] in text and r["doc_id"] != 300:
            want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_pii(text[r["doc_id"]]))
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"].startswith(want)
    clean = pii.sanitise(docs_of(rows))
    assert clean.columns == docs_of(rows).columns
    for r in clean.collect():
        assert not pii.base_spans(r["text"]) and "Zanzibari" not in (r["text"] or "")
    assert sum(r["text"] is None for r in clean.collect()) == 1
    assert pii.find(docs_of([])).collect() == [] and pii.sanitise(docs_of([])).collect() == []


def test_pii_scores_entities_of_one_or_two_contexts(docs_of):
    rows = [(k, f"the meeting of {k % 7} people was about the budget and the plan") for k in range(4000)]
    rows += [(5000, "the meeting was led by Quillfeather with rare@mail.example.com about the budget")]
    rows += [(6000 + k, f"the {'plan' if k else 'budget'} was by Umberfield at twice@mail.example.com and the meeting") for k in range(2)]
    text = dict(rows)
    for r in pii.find(docs_of(rows)).where("doc_id >= 5000").collect():
        terms = {text[r["doc_id"]][int(s) : int(e)] for k, s, e in (x.split(":") for x in r["spans"].split(",")) if k == "term"}
        assert ("Quillfeather" if r["doc_id"] == 5000 else "Umberfield") in terms and not terms & {"the", "budget", "meeting"}


def test_pii_terms_far_from_the_mention(docs_of):
    fill = lambda k, n: " ".join(f"{chr(97 + k)}{chr(97 + j % 26)}x" for j in range(n))
    rows = [(k, f"{fill(k, 20)} Zanzibari zed@mail.example.com {fill(k, 60)} ZANZIBARI {fill(k, 200)} zanzibari") for k in range(8)]
    rows += [(100 + k, f"plain text number {k} of the corpus") for k in range(200)]
    for r in pii.sanitise(docs_of(rows)).collect():
        assert "zanzibari" not in r["text"].lower()
    spans = [r["spans"].split(",") for r in pii.find(docs_of(rows)).where("doc_id < 8").collect()]
    for (_, text), own in zip(rows, spans, strict=False):
        assert sum(text[int(s) : int(e)].lower() == "zanzibari" for k, s, e in (x.split(":") for x in own) if k == "term") == 3


def test_a_credential_among_the_words_does_not_silence_the_grammar():
    rng = random.Random(5)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n)).translate(secrets._FORMAT)
    every = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    labelled, more = ([pick(every, 32) for _ in range(n)] for n in (200, 50))
    words = [pick("abcdefghijklmnopqrstuvwxyz", rng.randint(8, 14)) for _ in range(300)]
    scorer = secrets.Scorer({"assign": labelled}, [*words, pick(every, 32)])
    assert sum(scorer.score(x)[1] for x in more) >= 45


def test_candidates_are_as_short_as_labelled_values():
    assert [c[:2] for c in secrets.candidates("so hunter22 or a1b2c3 or a1b2c", [])] == [(3, 11), (15, 21)]


def brute_alergia(strings, alpha):
    """States as sets of prefixes, merged and made deterministic by closure: slow, but plainly what the paper says."""
    count = lambda p: sum(x.startswith(p) for x in strings)
    prefixes = sorted({x[:k] for x in strings for k in range(len(x) + 1)})
    symbols = sorted(set("".join(strings)))
    group = {p: frozenset([p]) for p in prefixes}
    name = {g: p for p, g in group.items()}
    visits = lambda g: sum(map(count, g))
    ends = lambda g: sum(strings.count(p) for p in g)
    step = lambda g, c: next((group[p + c] for p in sorted(g) if p + c in group), None)
    taken = lambda g, c: sum(count(p + c) for p in g if p + c in group)

    def alike(g, h):
        n, m = visits(g), visits(h)
        bound = (0.5 * __import__("math").log(2 / alpha)) ** 0.5 * (n**-0.5 + m**-0.5)
        if abs(ends(g) / n - ends(h) / m) > bound or any(abs(taken(g, c) / n - taken(h, c) / m) > bound for c in symbols):
            return False
        return all(alike(x, y) for c in symbols if (x := step(g, c)) and (y := step(h, c)) and x != y)

    def union(g, h):
        """The set of h joins that of g; so do, for each symbol, the sets that follow.  A set goes by one prefix of g's."""
        name[group[g] | group[h]] = name[group[g]]
        after = [(c, step(group[g], c), step(group[h], c)) for c in symbols]
        both = group[g] | group[h]
        for p in both:
            group[p] = both
        for _, x, y in after:
            if x and y and group[min(x)] != group[min(y)]:
                union(name[group[min(x)]], min(y))

    red = [""]
    while True:
        blue = [(r, c) for r in sorted(red) for c in symbols if (g := step(group[r], c)) and not any(group[x] == g for x in red)]
        if not blue:
            return {min(group[r]): (visits(group[r]), ends(group[r]), {c: taken(group[r], c) for c in symbols if taken(group[r], c)}) for r in red}
        q = step(group[blue[0][0]], blue[0][1])
        into = next((r for r in red if alike(group[r], q)), None)
        if into is None:
            red.append(name[q])
        else:
            union(into, min(q))


def test_state_merging_is_that_of_the_paper():
    rng = random.Random(21)
    for alpha in (0.05, 0.5, 0.9):
        for _ in range(12):
            strings = ["".join(rng.choice("ab" if k % 2 else "abc") for k in range(rng.randint(1, 5))) for _ in range(rng.randint(5, 60))]
            a = secrets.Automaton.infer(sorted(strings), alpha)
            live, stack = set(), [0]
            while stack:
                x = stack.pop()
                if x not in live:
                    live.add(x)
                    stack += [t[0] for t in a.next[x].values()]
            got = sorted((a.visits[x], a.ends[x], sorted((c, t[1]) for c, t in a.next[x].items())) for x in live)
            want = sorted((v, e, sorted(n.items())) for v, e, n in brute_alergia(strings, alpha).values())
            assert got == want


def test_scores_are_likelihoods_of_the_automaton():
    a = secrets.Automaton.infer(["ab"] * 30 + ["a"] * 10)
    assert abs(a.likelihood("ab") - __import__("math").log(30 / 40)) < 1e-9 and abs(a.likelihood("a") - __import__("math").log(10 / 40)) < 1e-9


def test_keys_of_learned_formats_are_found_and_other_formats_are_not(docs_of):
    rng = random.Random(6)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    letters, every = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = lambda: " ".join(pick(letters, rng.randint(2, 12)) for _ in range(30))
    styles = [lambda: "ghx_" + pick(every, 36), lambda: "sk-" + pick(every, 44)]
    plain = [lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: f"{pick(letters, 6)}{rng.randrange(10, 99)}", lambda: f"2024-0{rng.randint(1, 9)}-{rng.randrange(10, 28)}T{rng.randrange(10, 23)}", lambda: f"v{rng.randrange(9)}.{rng.randrange(99)}.{rng.randrange(99)}"]
    rows = [(k, f"{words()} token: {styles[k % 2]()} {words()}") for k in range(200)]
    rows += [(1000 + k, f"{words()} {plain[k % 4]()} {words()}") for k in range(200)]
    rows += [(2000 + k, f"{words()} {styles[k % 2]()} {words()}") for k in range(20)]
    got = {r["doc_id"]: r for r in secrets.find(docs_of(rows)).collect()}
    assert sum(got[2000 + k]["n_grammar"] for k in range(20)) >= 18
    assert sum(got[1000 + k]["n_grammar"] for k in range(200)) <= 2
    assert sum(got[k]["n_likely"] for k in range(200)) >= 190 and got[0]["best_score"] > 0


def test_a_very_long_text_with_many_secrets_takes_its_time_in_proportion(docs_of):
    text = "token=abc123 a1b2c3d4 " * 20_000
    r = secrets.find(docs_of([(1, text), (2, None)])).where("doc_id = 1").first()
    assert r["n_assign"] == 20_000 and r["spans"].count("assign") == 20_000
    assert secrets.find(docs_of([(1, "k3y" * 50_000)])).first()["spans"] == ""


def test_every_text_with_a_span_may_have_one(spark):
    rng = random.Random(31)
    texts = ["".join(rng.choice(PII_BITS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t").withColumn("may", F.col("t").rlike(pii._MAY))
    for r in df.collect():
        assert r["may"] or not pii.base_spans(r["t"])


def test_disclosures_by_brute_force(docs_of):
    rng = random.Random(32)
    vocabulary = [f"{a}{b}{c}" for a in "bcd" for b in "aeiou" for c in "lmnrst"]
    people = [(f"p{k}@mail.example.com", f"name{'abcdefgh'[k]}") for k in range(8)]
    rows = []
    for k in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        if k % 5 == 0:
            mail, name = people[k // 5 % 8]
            at = rng.randrange(len(words))
            words[at:at] = [name if rng.random() < 0.8 else rng.choice(vocabulary), mail.upper() if rng.random() < 0.3 else mail]
        rows.append((k, " ".join(words)))
    rows += rows[:10] + [(None, None), (999, "")]
    df, contexts, texts = {}, {}, [t for _, t in rows if t]
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            df[w] = df.get(w, 0) + 1
        for _, s, e in brute_pii(t):
            spans = brute_pii(t)
            words = [m for m in re.finditer(r"[^\W\d_]+", t) if all(m.end() <= a or z <= m.start() for _, a, z in spans)]
            near = [m[0].lower() for m in words if m.start() < s][-pii.WINDOW :] + [m[0].lower() for m in words if m.start() >= s][: pii.WINDOW]
            contexts.setdefault("email:" + t[s:e].lower(), set()).add(tuple(near))
    want, n = {}, len(rows)
    for who, seen in contexts.items():
        for w in {w for c in seen for w in c}:
            pair = sum(w in c for c in seen)
            k, m, z = min(pair, df[w]), df[w], pii.Z
            p = (k / m + z * z / (2 * m) - z * ((k / m) * (1 - k / m) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)
            d = 1 + __import__("math").log2(p) / -__import__("math").log2(len(seen) / n)
            if d >= 0.6:
                want[who, w] = d
    docs = docs_of(rows)
    scanned = pii.scan(docs).where("text_key is not null").groupBy("text_key").agg(F.first("mentions").alias("mentions"), F.first("held").alias("held"))
    got = {(r["entity"], r["term"]): r["disclosure"] for r in pii.disclosures(scanned, docs, least=0.6).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {w for _, w in want} & {name for _, name in people}


def test_term_counts_do_not_depend_on_the_filter(spark, docs_of):
    rng = random.Random(33)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(200)]
    terms = spark.createDataFrame([(w,) for w in words[::3]], "term string")
    want = {w: n for w in words[::3] if (n := sum(w in t.split() for _, t in rows))}
    for bits in (64, 1 << 16):
        assert {r["term"]: r["df"] for r in pii.term_frequencies(docs_of(rows), terms, bits=bits).collect()} == want


def test_contexts_are_whole_words(docs_of):
    long = "q" * 400
    [m] = pii.mentions(f"{long} me@mail.example.com {long}x", [("email", 401, 420)])
    assert m["terms"] == [long, long + "x"]
    text = "one two me@mail.example.com three " * 3000
    assert pii.find(docs_of([(1, text)])).first()["n_email"] == 3000
