"""Words, windows and terms are the same only if their bytes are."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from inferframe.llm import decontaminate, near_dup, ngram_lm, pretokenize, queries, shared, store, substring_dedup, textops
from tests.llm.test_bpe import PATH, expected, reference
from tests.llm.test_dedup import brute_windows

# the words of 2,048 letters on which every polynomial modulo 2^64 with an odd base agrees
A = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
B = A.translate(str.maketrans("ab", "ba"))


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bpe(spark):
    own = reference()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_columns(table(spark, A, B), PATH, public_tokenizers.PATTERN).collect()}
    assert got == {0: expected(A, own), 1: expected(B, own)}


def test_substring_dedup(spark):
    ws = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join([*ws[:20], A, *ws[21:]])), (1, " ".join([*ws[:20], B, *ws[21:]])), (2, " ".join([*ws[:20], B, *ws[21:]]) + " end")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == brute_windows(rows)


def test_windows_are_told_apart_by_either_hash():
    keys = np.array([[5, 1], [5, 2], [5, 1], [7, 7], [5, 3], [5, 2]], np.uint64)
    order = substring_dedup._in_order(keys)
    assert len(substring_dedup._begins(keys[order])) == 4
    known = pa.table({"repeated": pa.array([keys[:2].tobytes()], pa.binary())})
    assert substring_dedup._among(keys, known).tolist() == [True, True, True, False, False, True]


def test_decontamination(spark):
    ws = [f"w{i}" for i in range(14)]
    items = spark.createDataFrame([(1, " ".join([*ws[:7], A, *ws[7:]]))], "item_id long, text string")
    docs = table(spark, " ".join([*ws[:7], B, *ws[7:]]), " ".join(["x", *ws[:7], A, *ws[7:]]))
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.decontaminate(docs, items).collect()) == [(0, 0), (1, 15)]


def test_decontamination_without_hashes_and_over_the_whole_shard(monkeypatch):
    monkeypatch.setattr(textops.Words, "hashes", lambda self, seed=42: np.zeros(len(self), np.int64))
    rng = np.random.default_rng(3)
    ws = [f"w{i}" for i in range(30)]
    items = [(str(i), " ".join(rng.choice(ws, rng.integers(0, 25)))) for i in range(20)]
    patterns = decontaminate.Patterns(items, 5)
    texts = [" ".join(rng.choice([*ws, "other", "more"], 60)) for _ in range(30)] + [t for _, t in items] + [""]
    _, first, number, own = next(textops.distinct_words(pa.array(texts), textops.ALNUM))
    symbols = patterns.symbols_of(own)[number]
    hit, doc, item = decontaminate.find(patterns, symbols, first)
    for a, b in zip((hit, doc, item), decontaminate.find(patterns, symbols, first, every=True)):
        assert np.array_equal(a, b)
    want = set()
    mask = np.zeros(len(hit), bool)
    for d, t in enumerate(texts):
        tw = t.split()
        for k, (i, it) in enumerate(items):
            iw = it.split()
            for a in range(max(1, len(iw) - 4) if iw else 0):
                w = iw[a : a + 5]
                for c in range(len(tw) - len(w) + 1):
                    if tw[c : c + len(w)] == w:
                        want.add((d, i))
                        mask[first[d] + c : first[d] + c + len(w)] = True
    assert {(d, patterns.ids[i]) for d, i in zip(doc.tolist(), item.tolist())} == want
    assert np.array_equal(hit, mask)


def test_language_model(spark):
    docs = table(spark, A, "c", B)
    got = {r.doc_id: r for r in ngram_lm.lm_scores(docs, F.col("doc_id") == 2).collect()}
    assert (got[2].n_tokens, got[2].n_known, got[0].n_known) == (2, 1, 2)


def test_store_with_one_hash_for_all(spark):
    words = sorted({w for i in range(300) for w in (f"w{i}", "x" * i)})
    df = spark.createDataFrame([(5, w, [len(w), i]) for i, w in enumerate(words)], "h long, word string, ids array<int>").repartition(3)
    stored = store.write_store(df, "one-hash", shards=7)
    assert sum(stored.rows) == len(words)
    own = store.HashStore(stored)
    asked = textops.words_of(pa.array(words, pa.binary()))
    at, n, ids = own.lists(np.full(len(words), 5), "ids", asked)
    assert n.tolist() == [2] * len(words)
    assert [ids[a : a + 2].tolist() for a in at] == [[len(w), i] for i, w in enumerate(words)]


def test_missing_files_raise(spark):
    stored = store.write_store(spark.createDataFrame([(i * 3 << 40, i) for i in range(50)], "h long, n long"), "missing", shards=2)
    assert stored.sums == {"n": sum(range(50))}
    shard = next(i for i, n in enumerate(stored.rows) if n)
    os.rename(f"{stored.folder}/{shard}-n", f"{stored.folder}/gone")
    with pytest.raises(FileNotFoundError):
        store.HashStore(stored).array(shard, "n")


def test_store_survives_a_task_that_fails_half_way(spark):
    rows = [(i * 7919 << 36, f"w{i}") for i in range(-4000, 4000)]

    def failing(batch):
        context = TaskContext.get()
        if context.attemptNumber() == 0 and context.partitionId() % 2 and batch.column(0)[-1].as_py() % 3:
            raise RuntimeError("lost")
        return batch

    df = spark.createDataFrame(rows, "h long, word string").repartition(5)
    stored = store.write_store(df, "failing", shards=4, complete=failing)
    assert sum(stored.rows) == len(rows)
    own = store.HashStore(stored)
    found = [(int(h), w) for i in range(4) if stored.rows[i] for h, w in zip(own.array(i, "h"), textops.Words(own.array(i, "word-at"), own.array(i, "word")).array().to_pylist())]
    assert found == sorted(rows)


def test_many_partitions_and_the_named_folder(spark, tmp_path, monkeypatch):
    """With 200 shuffle partitions most shards are empty; files go to the shared folder (its setting can't change in a session)."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    monkeypatch.setattr(shared, "checkpoint_dir", lambda _: f"file://{tmp_path}/shared")
    try:
        own, texts = reference(), ["one two", "two three \u00e9", None]
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_columns(table(spark, *texts), PATH, public_tokenizers.PATTERN).collect()}
        assert got == {i: expected(t, own) for i, t in enumerate(texts)}
        assert [p for p in os.listdir(tmp_path / "shared") if p.startswith("bpe-words")]
        scores = ngram_lm.lm_scores(table(spark, "a b", "b a", "c"), F.col("doc_id") == 2).collect()
        assert {r.doc_id: r.n_known for r in scores} == {0: 3, 1: 3, 2: 1}
        rows = [(0, " ".join(map(str, range(40)))), (1, "x " + " ".join(map(str, range(40)))), (2, "y")]
        kept = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in kept) == brute_windows(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hashes_are_xxh64(spark):
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in [*range(40), *rng.integers(0, 40, 400), 300, 5000]]
    own = textops.words_of(pa.array(words, pa.binary()))
    for seed in (42, 7, 0):
        assert own.hashes(seed).view(np.uint64).tolist() == [xxhash.xxh64_intdigest(w, seed) for w in words]
    texts = ["", "a", "four", "eightsss", "ninebytes", "z\u00e4hlen", "x" * 31, "y" * 32, "w" * 1000]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()] == textops.words_of(pa.array(texts)).hashes().tolist()


# two words that XXH64 takes for the same with the seed 42 and with 7
SAME = ('c$#$"k<qabcdefghabcdefghabcdefgh\'bk"dfb\'abcdefghabcdefghabcdefgh', 'c$#$"k,,abcdefghabcdefghabcdefgh\'b#(d/<fabcdefghabcdefghabcdefgh')


def test_chosen_words(spark):
    """Documents that differ in one of these words alone share no window of 35, and no shingle where they are all there is."""
    assert all(xxhash.xxh64_intdigest(SAME[0], seed) == xxhash.xxh64_intdigest(SAME[1], seed) for seed in (42, 7))
    ws = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*ws[:20], w, *ws[21:]])) for i, w in enumerate(SAME)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == brute_windows(rows) and all(r.n_removed == 0 for r in got)
    rows = [(i, w) for i, w in enumerate(SAME)] + [(5, SAME[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.near_dup_components(docs).collect()) == [(0, 0), (1, 1), (5, 0)]
    assert sorted(r.doc_id for r in near_dup.near_dedup(docs).collect()) == [0, 1]


def test_digests_tell_words_apart():
    words = [*SAME, "a", "", SAME[0], "\0", "\0\0", "x" * 15, "x" * 16, "é" * 7, "a" + "\0" * 14]
    own = textops.words_of(pa.array(words))
    for found in (own.digests(), own.keyed((3, 5, 7, 9)), own.keyed((1 << 63 | 1, 5, 11, 13))):
        assert len({x.tobytes() for x in found}) == len(set(words)) and (found[0] == found[4]).all()
    many = textops.words_of(pa.array([str(i) for i in range(200_000)]))
    for half in many.keyed((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)).T:
        assert len(np.unique(half)) == 200_000  # either half alone spreads
        assert abs(np.bincount((half >> np.uint64(60)).astype(np.int64)) - 12_500).max() < 700


def test_splits_at_every_character():
    """All code points in places where their class matters (of planes 4 to 13, without characters, every seventh): matches are those of the library that is followed."""
    own, split = reference(), pretokenize.splitter_of(public_tokenizers.PATTERN)
    every = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and (not 0x40000 <= i < 0xE0000 or i % 7 == 0)]
    known = {p.encode(): own._encode_single_piece(p.encode()) for p in ("'s", "'", "s", "1", "2", "\n", " ", "x", " x")}
    for a in range(0, len(every), 1 << 16):
        texts = [f"{c}'s\n {c}x\n1{c}2\n{c}{c} {c}" for c in every[a : a + (1 << 16)]]
        made: list[list[int]] = [[] for _ in texts]
        for first, offsets, data in textops.pieces(pa.array(texts)):
            starts, raw = split(offsets, data), data.tobytes()
            of = np.searchsorted(offsets, starts, side="right") - 1
            for r, x, y in zip(of.tolist(), starts.tolist(), [*starts[1:].tolist(), len(raw)], strict=True):
                piece = raw[x:y]
                made[first + r] += known.get(piece) or own._encode_single_piece(piece)
        assert made == own.encode_ordinary_batch(texts, num_threads=2)


def test_many_repeats_of_one_id(spark):
    """One row for each id: that with the least digest, whatever the order."""
    rows = [(1, "b"), (1, "a"), (1, None), (2, "x"), (None, "n"), (None, "n")]
    for seed in (1, 2):
        docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(seed)).repartition(3)
        got = near_dup.one_of_each(docs.where("doc_id IS NOT NULL"), docs, "doc_id", "text").collect()
        least = min(["b", "a", ""], key=lambda t: hashlib.sha256(t.encode()).hexdigest())
        assert sorted((r.doc_id, r.text or "") for r in got) == [(1, least), (2, "x")]


def test_no_folder_off_one_machine():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda *_: None)})())})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.checkpoint_dir(Session())
