import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inferframe.llm import fingerprints as fp
from inferframe.llm.fingerprints import Sampler, fingerprint_edits, fingerprints, gamma_quantiles, likeness
from inferframe.llm.queries import op11_fingerprints
from inferframe.llm.textops import mix
from tests.conftest import SF


def bag(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return Counter(w for w in re.split("[\x20\x09-\x0d]+", text) if w)


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def plain_signature(sampler, text):
    """Sample by sample and term by term, by the formula with logarithms of its own."""
    import xxhash

    terms = [(np.array([xxhash.xxh64_intdigest(w, 42)], np.uint64), n) for w, n in bag(text).items()]
    if not terms:
        return [fp.NONE] * sampler.samples
    out = []
    for i in range(sampler.samples):
        best = None
        for h, n in terms:
            x = int(mix(h ^ sampler.salts[i : i + 1])[0])
            r, log_c, b = float(sampler.r[x & 0xFFFF]), float(sampler.log_c[x >> 16 & 0xFFFF]), ((x >> 32 & 0xFFFF) + 0.5) / 65536
            t = int(np.floor(np.float32(np.log(n)) / np.float32(r) + np.float32(b)))
            found = log_c - r * (t - b) - r, min((x >> 48) + t * 0x9E37 & 0xFFFF, fp.NONE - 1)
            best = min(best, found) if best else found
        out.append(best[1])
    return out


def some_texts(n=60, seed=2):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(80)]
    return [None, "", " \n", "one", "ONE", "a\x00b"] + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(n)]


def test_quantiles_are_those_of_the_gamma_distribution():
    x = gamma_quantiles()
    u = 1 - (1 + x) * np.exp(-x)
    assert np.abs(u - (np.arange(len(x)) + 0.5) / len(x)).max() < 1e-9 and (np.diff(x) > 0).all()


def test_signatures_equal_the_plain_formula():
    sampler, texts = Sampler(32), some_texts(20)
    got = sampler.signatures(pa.array(texts, pa.string()))
    want = np.array([plain_signature(sampler, t) for t in texts])
    assert (got == want).mean() > 0.999  # sums in single and double precision may order two terms differently


def test_blocks_and_pieces_do_not_matter(monkeypatch):
    texts = some_texts()
    whole = Sampler().signatures(pa.array(texts))
    monkeypatch.setattr(fp, "BLOCK", 3)
    monkeypatch.setattr(fp, "SAMPLED", 200)
    assert (Sampler().signatures(pa.array(texts)) == whole).all()
    assert all((Sampler().signatures(pa.array([t], pa.string())) == s).all() for t, s in zip(texts, whole, strict=True))


def test_collision_rate_is_generalised_jaccard():
    """Over 2,000 samples the rate is within four standard deviations, for weights that differ."""
    sampler = Sampler(2000)
    pairs = [("a a a b b c", "a b b b c c d"), ("x " * 9 + "y", "x y"), ("a b c d e f", "a b c d e g"), ("m n", "o p"), ("q " * 50, "q " * 40)]
    for a, b in pairs:
        want = jaccard(bag(a), bag(b))
        s = sampler.signatures(pa.array([a, b]))
        assert abs((s[0] == s[1]).mean() - want) <= 4 * (want * (1 - want) / 2000) ** 0.5 + 0.001


def test_rate_has_no_bias():
    """Over many seeds the mean error on texts with common words vanishes."""
    texts = some_texts(40, 8)[6:]
    want = [jaccard(bag(a), bag(b)) for a, b in zip(texts, texts[1:], strict=False)]
    found = []
    for seed in range(1, 31):
        s = Sampler(128, seed).signatures(pa.array(texts))
        found.append(((s[:-1] == s[1:]).mean(axis=1) - want).mean())
    assert abs(np.mean(found)) < 4 * np.std(found) / 30**0.5 + 0.001


def edits(rows):
    """(n_chars, digest of the edited text, next text) of rows in order."""
    out = []
    for i, (_, t) in enumerate(rows):
        n, following = len(t), rows[(i + 1) % len(rows)][1]
        out.append((n, hashlib.sha256((t[: n - n // 2] + following[: n // 2]).encode()).hexdigest(), following))
    return out


def test_edits_of_a_small_table(spark, monkeypatch):
    """Every row meets its next one over parts and batches; nulls, empty and very long texts, clashing columns."""
    monkeypatch.setattr(fp, "PART_BYTES", 500)
    texts = some_texts() + ["long é " * 100000]
    rng = random.Random(4)
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([(i, t, 1) for i, t in shuffled], "doc_id long, text string, n_chars int").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r.doc_id: r for r in fingerprint_edits(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    rows = [(i, t or "") for i, t in rows]
    sampler = Sampler()
    own = sampler.signatures(pa.array([t for _, t in rows]))
    assert len(got) == len(rows)
    for k, ((i, t), (n, digest, following)) in enumerate(zip(rows, edits(rows), strict=True)):
        changed = sampler.signatures(pa.array([t[: n - n // 2] + following[: n // 2]]))[0]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.fingerprint == own[k].astype(">u2").tobytes().hex() and r.edited_fingerprint == changed.astype(">u2").tobytes().hex()
        assert r.near_edited == (own[k] == changed).mean() and r.near_next == (own[k] == own[(k + 1) % len(rows)]).mean()


def test_repeated_and_null_ids(spark):
    """All rows stay; rows of one id follow each other; null ids come first; equal rows are next to each other."""
    rows = [(None, "n1 x"), (None, "n2 y"), (1, "same t"), (1, "same t"), (1, "other u"), (2, "last v")]
    got = [tuple(r)[:3] for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    order = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text").orderBy("doc_id", F.xxhash64("text"), "text").collect()
    want = [(r.doc_id, n, d) for r, (n, d, _) in zip(order, edits([(r.doc_id, r.text) for r in order]), strict=True)]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("rows", [[], [(5, "alone here")], [(5, None)]])
def test_tiny_tables(spark, rows):
    got = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.near_next == 1.0 for r in got)


def test_column_and_likeness(spark):
    """The column form has the same fingerprints, and likeness in SQL functions is the share of equal samples."""
    texts = some_texts(20)
    out = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fingerprint", F.lit(0)))
    rows = {r.doc_id: r.fingerprint for r in out.collect()}
    s = Sampler().signatures(pa.array(texts))
    assert rows == {i: x.astype(">u2").tobytes().hex() for i, x in enumerate(s)}
    pairs = out.alias("a").crossJoin(out.where("doc_id < 8").alias("b")).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("x"))
    assert all(r.x == (s[r.i] == s[r.j]).mean() for r in pairs.collect())


def test_query_follows_similarity(spark):
    """On a whole table the likeness of each text to its edited form is its generalised Jaccard similarity but for sampling."""
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = [(r.doc_id, r.text or "") for r in docs]
    got = {r.doc_id: r for r in op11_fingerprints(spark, SF).collect()}
    off = {"edited": [], "next": []}
    for (i, t), (n, digest, following) in zip(rows, edits(rows), strict=True):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        off["edited"].append(r.near_edited - jaccard(bag(t), bag(t[: n - n // 2] + following[: n // 2])))
        off["next"].append(r.near_next - jaccard(bag(t), bag(following)))
    for x in off.values():
        assert abs(np.mean(x)) < 0.015 and np.std(x) < 0.045  # texts share words, and with them their samples' errors
    assert len({r.fingerprint for r in got.values()}) == len({tuple(sorted(bag(t).items())) for _, t in rows})
