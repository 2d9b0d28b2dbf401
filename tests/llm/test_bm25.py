import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from inferframe.llm import bm25, textops


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, queries, k):
    tfs = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in tfs]
    mean, df = max(sum(sizes) / max(len(docs), 1), 1e-9), Counter(t for c in tfs for t in c)
    out = []
    for q, text in queries:
        want = Counter(terms(text))
        scored = []
        for (i, _), c, size in zip(docs, tfs, sizes):
            s = sum(n * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t, n in sorted(want.items()) if t in c)
            if s > 0:
                scored.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored, key=lambda x: (x[0], -1 if x[1] is None else x[1]))[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and abs(x[3] - y[3]) < 2e-6, (x, y)


def test_many_shards_and_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(5)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    asked = [r for r in rows if r[0] % 7 == 0]
    queries = spark.createDataFrame(asked, "doc_id long, text string")
    for shard, block, group in ((20_000, 5, 2), (24 << 20, 256, 4)):
        same(got(bm25.bm25_top_k(docs, queries, k=5, shard_bytes=shard, block_queries=block, group=group)), brute(rows, asked, 5))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "a b"), (4, "a b"), (5, "A! b? c" * 3), (None, "c d"), (7, "zz " * 5000), (8, "é É")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    asked = [(3, "a b"), (1, None), (9, "nothing here"), (10, "a a a c zz É")]
    queries = spark.createDataFrame([*asked, (None, "a")], "doc_id long, text string")
    same(got(bm25.bm25_top_k(docs, queries, k=3)), brute(rows, asked, 3))
    assert got(bm25.bm25_top_k(docs.limit(0), queries)) == [] and got(bm25.bm25_top_k(docs, queries.limit(0))) == []


def shard_of(tokens, sizes):
    """(shard, place of each token in it) of tokens that are whole numbers."""
    own, numbers = np.unique(tokens, return_inverse=True)
    shard = bm25.Shard.build(pa.array(np.arange(len(sizes))), numbers, sizes, pa.array([str(x).encode() for x in own], pa.binary()))
    shard.prepare(float(sizes.mean()))
    return shard, {int(w): i for i, w in enumerate(textops.Words(shard.word_at, shard.word).array().to_pylist())}


def plain_scores(shard, places, weights):
    want = np.zeros(len(shard.length))
    for p, w in zip(places, weights):
        own = slice(shard.term_posts[p], shard.term_posts[p + 1])
        want[shard.docs[own]] += w * shard.impact[own]
    return np.round(want, 6)


def best(shard, scores, k):
    order = np.lexsort((shard.ids, -scores))[:k]
    return order[scores[order] > 0]


def test_bounds_lose_no_result():
    rng = np.random.default_rng(0)
    sizes = rng.integers(5, 40, 3000)
    shard, place_of = shard_of(rng.zipf(1.3, sizes.sum()) % 500, sizes)
    for _ in range(40):
        places = np.sort(rng.choice(len(place_of), 6, replace=False))
        weights = np.log(1 + 3000 / shard.document_frequencies()[places])
        docs, scores = shard.search(places, weights, 10)
        want = plain_scores(shard, places, weights)
        order = best(shard, want, 10)
        assert (docs == order).all() and np.allclose(scores, want[order])
        fewer, _ = shard.search(places, weights, 10, want[order[4]])
        assert set(order[:5].tolist()) <= set(fewer.tolist())
        for k in (1, 2, 5):
            head, _ = shard.search(places, weights, k)
            assert head.tolist() == order[:k].tolist()


def test_whole_text_queries_skip_postings(monkeypatch):
    """Every hundredth supplied text against all: the results are those of plain sums, and not all postings are read."""
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).combine_chunks()
    numbers, sizes, terms = bm25._terms(rows.column("text").chunk(0))
    shard = bm25.Shard.build(rows.column("doc_id").chunk(0), numbers, sizes, terms)
    shard.prepare(float(sizes.mean()))
    own = bm25._in_order(numbers, terms)[0]
    at, df = np.concatenate([[0], np.cumsum(sizes)]), shard.document_frequencies()
    read, real, every, entries = [], bm25.expand, 0, 0
    monkeypatch.setattr(bm25, "expand", lambda starts, sizes: (read.append(int(np.sum(sizes))), real(starts, sizes))[1])
    for q in range(0, len(sizes), 100):
        places, n = np.unique(own[at[q] : at[q + 1]], return_counts=True)
        weights = n * np.log(1 + (len(sizes) - df[places] + 0.5) / (df[places] + 0.5))
        docs, scores = shard.search(places, weights, 10)
        every, entries = every + df[places].sum(), entries + (shard.term_at[places + 1] - shard.term_at[places]).sum()
        if q % 1000 == 0:
            want = plain_scores(shard, places, weights)
            assert docs.tolist() == best(shard, want, 10).tolist()
    assert sum(read) - entries < 0.95 * every


def test_frequent_terms_are_not_read_as_postings(monkeypatch):
    """Whole texts as queries: with a floor, fewer than a third of the postings and entries are read, many queries' frequent scores are those of one, and equal documents have equal scores."""
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).slice(0, 3000).combine_chunks()
    rows = pa.concat_tables([rows, rows.slice(0, 500)]).combine_chunks()
    numbers, sizes, terms = bm25._terms(rows.column("text").chunk(0))
    shard = bm25.Shard.build(pa.array(np.arange(len(sizes))), numbers, sizes, terms)
    shard.prepare(float(sizes.mean()))
    own = bm25._in_order(numbers, terms)[0]
    at, df = np.concatenate([[0], np.cumsum(sizes)]), shard.document_frequencies()
    assert 50 < len(shard.frequent) <= bm25.FREQUENT_CELLS // len(sizes)
    queries = []
    for q in range(0, 3000, 60):
        places, n = np.unique(own[at[q] : at[q + 1]], return_counts=True)
        queries.append((places, n * np.log(1 + (len(sizes) - df[places] + 0.5) / (df[places] + 0.5))))
    read, real = [], bm25.expand
    for (places, weights), frequent in zip(queries, shard.frequent_scores(queries), strict=True):
        want = plain_scores(shard, places, weights)
        order = best(shard, want, 10)
        docs, scores = shard.search(places, weights, 10)
        assert docs.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
        with monkeypatch.context() as m:
            m.setattr(bm25, "expand", lambda starts, sizes: (read.append(int(np.sum(sizes))), real(starts, sizes))[1])
            docs, scores = shard.search(places, weights, 10, want[order[-1]], frequent)
        assert docs.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert sum(read) < sum(df[places].sum() for places, _ in queries) / 3


def test_other_groups_start_from_floors(spark, monkeypatch):
    """Many groups of shards and blocks, copies on both sides of a floor: as all documents scored one by one."""
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words[(i * j * j + j) % (i % 23 + 5)] for j in range(12))) for i in range(150)]
    rows += [(1000 - i, t) for i, t in rows[:100]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = [r for r in rows if r[0] % 5 == 0]
    same(got(bm25.bm25_top_k(docs, spark.createDataFrame(asked, "doc_id long, text string"), k=4, shard_bytes=900, block_queries=3, group=2)), brute(rows, asked, 4))


def test_blocks_of_like_documents_are_skipped(monkeypatch):
    rng = np.random.default_rng(1)
    n, topics = 40 * bm25.BLOCK, 40
    weak = rng.integers(0, 400, n * 30)
    topic = np.repeat(np.arange(n) // bm25.BLOCK, 30)
    strong = 1000 + topic * 50 + rng.integers(0, 10, n * 30)
    shard, place_of = shard_of(np.where(rng.random(n * 30) < 0.5, strong, weak), np.full(n, 30))
    read, real = [], bm25.expand
    monkeypatch.setattr(bm25, "expand", lambda starts, sizes: (read.append(int(np.sum(sizes))), real(starts, sizes))[1])
    for t in range(topics):
        places = np.array([place_of[x] for x in (t, t + 100, 1000 + t * 50, 1001 + t * 50, 1002 + t * 50)])
        df = shard.document_frequencies()[places]
        weights = np.log(1 + (n - df + 0.5) / (df + 0.5))
        read.clear()
        docs, scores = shard.search(places, weights, 10)
        # the first call lists the blocks of the terms, the others the postings that are read
        assert sum(read[1:]) < 0.6 * df.sum()
        assert docs.tolist() == best(shard, plain_scores(shard, places, weights), 10).tolist()


def test_rank_does_not_depend_on_k(spark):
    rows = [(1, "a " * 3000), (2, "a " * 3001), (3, "b c"), (-(1 << 63), "d"), (None, "d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    asked = [(7, "a"), (8, "d")]
    queries = spark.createDataFrame(asked, "doc_id long, text string")
    for k in (1, 2, 3):
        same(got(bm25.bm25_top_k(docs, queries, k=k)), brute(rows, asked, k))
    assert got(bm25.bm25_top_k(docs, queries, k=1))[0][2] == 1


def test_terms_are_told_apart_by_bytes(spark, monkeypatch):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, f"{b} x"), (4, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(1, a), (4, "x z")]
    queries = spark.createDataFrame(asked, "doc_id long, text string")
    same(got(bm25.bm25_top_k(docs, queries, k=3)), brute(rows, asked, 3))


def test_equal_hashes_of_different_terms():
    """With one hash for all words their bytes decide alone."""
    words = [b"a", b"b", b"ab", b"ba", b"c"]
    known = textops.words_of(pa.array(words, pa.binary()))
    wanted = textops.words_of(pa.array([b"ba", b"zz", b"a", b"c", b""], pa.binary()))
    assert textops.locate(np.zeros(5, np.int64), known, np.zeros(5, np.int64), wanted).tolist() == [3, -1, 0, 4, -1]
