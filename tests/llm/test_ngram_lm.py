import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from inferframe.llm import ngram_lm, queries


def plain(rows):
    """(doc_id, text) pairs: the model with dictionaries."""
    def tokens(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]

    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    uni, bi, texts = Counter(), Counter(), 0
    for i, t in rows:
        if not held[i]:
            ts = tokens(t)
            uni.update(ts)
            bi.update(zip(["<s>", *ts[:-1]] if True else (), ts))
            texts += 1
    before, after = Counter(v for _, v in bi), {}
    for (u, _), c in bi.items():
        after.setdefault(u, [0, 0, 0])[min(c, 3) - 1] += 1
    d2 = ngram_lm.discounts([sum(c == k for c in bi.values()) for k in (1, 2, 3, 4)])
    d1 = ngram_lm.discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    n, v = sum(uni.values()), len(uni)
    spread = sum(d1[min(c, 3)] for c in before.values()) / len(bi) if bi else 1.0

    def word(w):
        return max(before[w] - d1[min(before[w], 3)], 0) / max(len(bi), 1) + spread / (v + 1)

    def p(u, w):
        size = texts if u == "<s>" else uni[u]
        if not size or (u == "<s>" and not texts):
            return word(w)
        return max(bi[u, w] - d2[min(bi[u, w], 3)], 0) / size + sum(a * b for a, b in zip(after[u], d2[1:])) / size * word(w)

    out = {}
    for i, t in rows:
        ts = tokens(t)
        out[i] = (held[i], len(ts), sum(uni[w] > 0 for w in ts), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *ts[:-1]], ts)))
    total = sum(p("<s>", w) for w in uni) + p("<s>", "not there")
    return out, total


def close(got, want):
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6 * max(1, abs(w[4])) and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])), (i, g, w)


def test_against_plain(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op2_lm_score(spark, "/root/testdata/sf0.01").collect()}
    want, total = plain([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])
    close(got, want)
    assert abs(total - 1) < 1e-9
    held = [r for r in got.values() if r[0]]
    assert len(held) > 50 and sum(r[5] for r in held) > sum(r[4] for r in held)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a A"), (4, "a A a"), (5, "b\x0bC\tc"), (11, "zz " * 3000), (12, "é ß É"), (13, "a a")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    got = ngram_lm.lm_scores(docs, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    close({r.doc_id: tuple(r)[1:] for r in got}, plain(rows)[0])
    alone = ngram_lm.lm_scores(docs, F.lit(True)).collect()
    assert len(alone) == len(rows) and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in alone)
    assert ngram_lm.lm_scores(docs.limit(0), held).collect() == []


def test_unmix():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert (ngram_lm.unmix(ngram_lm.mix(x)) == x).all()


def plain_trigrams(rows):
    """{doc_id: score} of order three with dictionaries, and the sum over the vocabulary after some contexts."""
    def tokens(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower), None]

    tri, bi = Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            ts = tokens(t)
            bi.update(zip(ts, ts[1:]))
            tri.update(zip(ts, ts[1:], ts[2:]))
    cont = Counter(x[1:] for x in tri)
    two = {x: c if x[0] == "<s>" else cont[x] for x, c in bi.items()}
    one = Counter(w for _, w in bi)
    d1, d2, d3 = (ngram_lm.discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (one, two, tri))
    levels = []
    for counts, d in ((two, d2), (tri, d3)):
        size, lost = Counter(), Counter()
        for x, c in counts.items():
            size[x[:-1]] += c
            lost[x[:-1]] += d[min(c, 3)]
        levels.append((counts, d, size, lost))
    spread = sum(d1[min(c, 3)] for c in one.values()) / len(bi)

    def p(context, w):
        if not context:
            return max(one[w] - d1[min(one[w], 3)], 0) / len(bi) + spread / (len(one) + 1)
        counts, d, size, lost = levels[len(context) - 1]
        lower = p(context[1:], w)
        if not size[context]:
            return lower
        c = counts.get((*context, w), 0)
        return (max(c - d[min(c, 3)], 0) + lost[context] * lower) / size[context]

    out = {}
    for i, t in rows:
        ts = tokens(t)
        out[i] = sum(math.log10(p(tuple(ts[max(0, j - 2) : j]), ts[j])) for j in range(1, len(ts)))
    return out, [sum(p(c, w) for w in [*one, "not there"]) for c in list(levels[1][2])[:20]]


def test_order_three_against_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "A a A"), (-4, "not heard of"), (-5, "a A a"), (-6, "zz " * 3000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    want, sums = plain_trigrams([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in ngram_lm.lm_scores(docs, held, order=3).collect()}
    assert got.keys() == want.keys() and all(abs(got[i].score - w) < 1e-6 * max(1, abs(w)) for i, w in want.items())
    assert all(abs(x - 1) < 1e-9 for x in sums)
    two = {r.doc_id: r for r in ngram_lm.lm_scores(docs, held).collect()}
    assert all(got[i][:6] == two[i][:6] for i in got) and sum(got[i].score for i in got) > sum(two[i].score for i in got)
    nothing = ngram_lm.lm_scores(docs, F.lit(True), order=3).collect()
    assert len(nothing) == len(got) and all(r.score == 0 for r in nothing)
    assert ngram_lm.lm_scores(docs.limit(0), held, order=3).collect() == []
