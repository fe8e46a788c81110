import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specimen.llm import encode, packing, tokenbin

ODD = ["a  b", "\ta b\n c", "x\n\ny", " lead", "trail ", "", "7 7 a7b 77", "don't we'll 'tis", "A.B,C!? d.. e,,", "é́ ñ Σίσυφος ΑΣ İi ﬁ", "<|endoftext|> hi<|endoftext|>x", "a\x1cb c\x85d e\xa0f", "漢字 かな 한국어", "\n", "\n7", "Foo.\nBar, baz\nqux", " . , ", "1,234.5 x٣४", "l'été d’accord", "a​b ́c", "0 7"]
KINDS = [("word_bpe_49k.json", "drop", "<u4"), ("byte_bpe_50k.json", "lead", "<u2")]


@pytest.mark.parametrize("name,mode,dtype", KINDS)
def test_memo_equals_library(name, mode, dtype):
    enc = encode.Encoder(encode.default_path(name), mode, dtype)
    assert enc.encode(ODD) == enc.whole(ODD) == enc.encode(ODD)


@pytest.mark.parametrize("name,mode,dtype", KINDS)
def test_memo_equals_library_on_any_text(name, mode, dtype):
    enc = encode.Encoder(encode.default_path(name), mode, dtype, memo_chunks=50)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abAB é́ß.,!?'7\n\t  \xa0　漢Σ<|>_-")))
    def same(text):
        assert enc.encode([text]) == enc.whole([text])

    same()


def brute_bins(sizes, capacity):
    """Fewest bins, by exhaustive search."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([10, 20, 37])
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 8))])
        low, fewest = packing.lower_bound(sizes, capacity), brute_bins(sorted(sizes.tolist(), reverse=True), capacity)
        bins = packing.best_fit_decreasing(sizes, capacity)[2]
        assert -(-int(sizes.sum()) // capacity) <= low <= fewest <= bins
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # the plain sum says 2
    assert packing.lower_bound(np.array([], np.int64)) == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_texts(docs_of):
    rows = [(None, None), (1, ""), (2, "word " * 3000), (3, "a b c"), (3, "a b c"), *[(k, "some text here " * (k % 90)) for k in range(4, 120)]]
    got = packing.pack(packing.pieces(docs_of(rows), capacity=256), capacity=256, part_rows=40).collect()
    assert check_packed(got, 256) <= 1.1 * -(-sum(r["length"] for r in got) // 256)
    enc = encode.Encoder(encode.default_path("word_bpe_49k.json"), "drop")
    want = []
    for d, t in rows:
        raw = enc.whole([t or ""])[0] + np.array([1], "<u4").tobytes()
        want += [(d, k, a // 4, len(raw[a : a + 1024]) // 4, zlib.crc32(raw[a : a + 1024])) for k, a in enumerate(range(0, len(raw), 1024))]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, [tuple(r)[:5] for r in got])) == sorted(map(key, want))
    assert packing.pack(packing.pieces(docs_of([]))).collect() == []


def test_exchange_of_gapped_parts_beats_one_round(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, 0, 0, rng.randint(30, 70), 0) for k in range(900)], packing._PIECES)
    once = check_packed(packing.pack(rows, 100, part_rows=60, rounds=1).collect(), 100)
    more = check_packed(packing.pack(rows, 100, part_rows=60, rounds=4).collect(), 100)
    assert packing.corpus_lower_bound(rows, 100) <= more <= once


def test_perfect_hash_is_minimal_and_turns_strangers_away():
    for n in (1, 2, 3, 10, 1000):
        keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
        index = tokenbin.PerfectHash.build(keys)
        assert sorted(index.slot(keys).tolist()) == list(range(n))
    shard = tokenbin.Shard(tokenbin.build_shard(3, [None, 1, 1, 5], [b"\1\0", b"\2\0\3\0", b"", b"\4\0"], 2) + tokenbin.END_MARK)
    assert shard.ids_of(1).tolist() == [2, 3] and shard.ids_of(5).tolist() == [4] and shard.ids_of(2) is None
    with pytest.raises(ValueError):
        tokenbin.Shard(b"x" * 100)


def test_token_round_trip(spark, docs_of, tmp_path):
    rows = [(None, "no key"), (2, None), (2, "tie"), (7, ""), (9, "hello world " * 200), *[(k, f"text {k}. Next\nline") for k in range(10, 200)]]
    docs = docs_of(rows)
    got = sorted(map(tuple, tokenbin.round_trip(docs, shard_bytes=500).collect()), key=lambda r: r[1])
    enc = encode.Encoder(encode.default_path("byte_bpe_50k.json"), "lead")
    ids = lambda t: enc.whole([t or ""])[0] + b"\2\0\0\0"
    at = 0
    for d, start, n, _ in got:
        assert start == at
        at += n
    assert [r[0] for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((d or -1, len(ids(t)) // 4, zlib.crc32(ids(t))) for d, t in rows)
    assert tokenbin.round_trip(docs_of([])).collect() == []
    path = f"file://{tmp_path}/shards"
    tokenbin.write(docs, path, shard_bytes=500)
    found = tokenbin.lookup(spark, tokenbin.directory(spark, path), [9, 150, 12345])
    assert set(found) == {9, 150} and len(found[9]) == len(ids("hello world " * 200)) // 4


def test_the_certificate_is_in_the_result(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(k, 0, 0, rng.choice([60, 40, 55, 70, 30]), 0) for k in range(300)], packing._PIECES)
    got = packing.pack(rows, 100, part_rows=50)
    sequences, least = packing.certificate(got, 100)
    packed = got.collect()
    assert sequences == check_packed(packed, 100) and least <= sequences
    assert least == packing.lower_bound(np.array([r["length"] for r in packed]), 100)
    total = {}
    for r in packed:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert all(r["full"] == (total[r["sequence_id"]] == 100) for r in packed) and all(r["gap"] >= 0 for r in packed)
    easy = packing.pack(spark.createDataFrame([(k, 0, 0, 50, 0) for k in range(64)], packing._PIECES), 100, part_rows=16).collect()
    assert {r["gap"] for r in easy} == {0} and check_packed(easy, 100) == 32


def test_a_very_long_text_is_cut_and_read_back(docs_of):
    text = "\n".join(f"line {k} of a very long text" for k in range(20_000))
    docs = docs_of([(1, text), (2, "x")])
    enc = encode.Encoder(encode.default_path("word_bpe_49k.json"), "drop")
    raw = enc.whole([text])[0] + np.array([1], "<u4").tobytes()
    got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(packing.pieces(docs)).collect() if r["doc_id"] == 1)
    assert got == [(k, 4096 * k, len(raw[a : a + 16384]) // 4, zlib.crc32(raw[a : a + 16384])) for k, a in enumerate(range(0, len(raw), 16384))]
    other = encode.Encoder(encode.default_path("byte_bpe_50k.json"), "lead")
    ids = other.whole([text])[0] + b"\2\0\0\0"
    r = tokenbin.round_trip(docs).where("doc_id = 1").first()
    assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (0, len(ids) // 4, zlib.crc32(ids))


def test_shards_of_one_partition_do_not_run_into_the_next(spark):
    """More shards in a range partition than twelve bits can number."""
    rows = [(k, f"t{k}") for k in range(9000)]
    got = sorted(map(tuple, tokenbin.round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), shard_bytes=1).collect()))
    at = 0
    for k, (d, start, n, _) in enumerate(got):
        assert (d, start) == (k, at)
        at += n


def test_lookups_read_bytes_and_not_shards():
    keys = sorted(random.Random(5).sample(range(10**9), 3000))
    raw = tokenbin.build_shard(1 << 40, keys, [np.arange(k % 50 + 1, dtype="<u2").tobytes() for k in range(3000)], 2) + tokenbin.END_MARK
    shard, taken = tokenbin.Shard(raw), []

    def read(offset, length):
        taken.append(length)
        return raw[offset : offset + length]

    assert shard.number == 1 << 40
    for k in (keys[0], keys[1234], keys[-1]):
        taken.clear()
        assert tokenbin.fetch(read, k).tolist() == shard.ids_of(k).tolist() and sum(taken) < 250
    strangers = [k for k in range(500) if k not in set(keys)]
    for k in strangers:
        taken.clear()
        assert tokenbin.fetch(read, k) is None and sum(taken) < 100


@pytest.mark.parametrize("name,mode,dtype", KINDS)
def test_a_chunk_is_new_once_in_a_group_however_full_the_memo(name, mode, dtype, monkeypatch):
    made, missing = [], encode._Memo.__missing__
    monkeypatch.setattr(encode._Memo, "__missing__", lambda memo, x: made.append(x) or missing(memo, x))
    enc = encode.Encoder(encode.default_path(name), mode, dtype, memo_chunks=0)
    texts = ["so kommt es", None, "", "wort", *["es kommt wort so"] * 500]
    assert enc.encode(texts) == enc.whole([t or "" for t in texts])
    assert len(made) <= 8  # four words, and in a text's first place again where the space counts


def test_what_is_put_together_from_chunks_takes_no_room_in_the_memo():
    enc = encode.Encoder(encode.default_path("byte_bpe_50k.json"), "lead", "<u2")
    texts = ["so ende.\nNeu wort, wort; ende*** wort&&&"]
    assert enc.encode(texts) == enc.whole(texts)
    assert set(enc.spaced) == {"ende", "wort"}


@pytest.mark.parametrize("name,mode,dtype", KINDS)
def test_runs_of_closing_marks(name, mode, dtype):
    enc = encode.Encoder(encode.default_path(name), mode, dtype)
    texts = [f"x {core}{tail} y{tail}\n{core}{tail}" for core in ("abc", "İ", "ñİ", "ª", "don't", "7", "a7b", "<|endoftext|>", "漢", "ʰ", "é") for tail in (".", ",!!", "***", "&&&", "%", "'.", "|>", ".̸")]
    assert enc.encode(texts) == enc.whole(texts)


def test_groups_reach_over_batches_and_rows_without_texts_are_bounded():
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["k", "t"])
    rows = [(k, None if k % 3 else "abc") for k in range(50)]
    got = list(encode.gathered([batch(rows[:20]), batch([]), batch(rows[20:])], most_chars=1000))
    assert [(k, t) for keys, texts in got for k, t in zip(keys, texts, strict=True)] == rows
    assert len(got) == 2 and len(got[0][0]) == 31  # 31 rows of 32, and three characters each for eleven of them
    assert list(encode.gathered([])) == []


@pytest.mark.parametrize("name,mode,dtype", KINDS)
def test_groups_beyond_short_offsets(name, mode, dtype, monkeypatch):
    monkeypatch.setattr(encode, "_SHORT", 0)
    enc = encode.Encoder(encode.default_path(name), mode, dtype)
    texts = [*ODD, None, "a b c", "x" * 50 + " y"]
    assert enc.encode(texts) == enc.whole([t or "" for t in texts])
