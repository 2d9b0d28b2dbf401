import base64
import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_dedup import brute_lines
from tests.llm.test_langid import plain
from tests.llm.test_near_dup import brute_components

SMALL = "/root/testdata/sf0.001"


def brute(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    languages = plain([(r.text, r.lang, r.source) for r in docs.values()])
    kept = {i: r.text for (i, r), (language, _) in zip(docs.items(), languages) if language != "und"}
    kept = {i: t for i, t, _, _ in brute_lines(list(kept.items()))}
    kept = {i: kept[i] for i, c in brute_components(list(kept.items())) if i == c}

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))

    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        ws = cut(r.text)
        windows |= {tuple(ws[a : a + 13]) for a in range(max(1, len(ws) - 12))} if ws else set()
    sizes = {len(w) for w in windows}
    clean = {}
    for i, t in kept.items():
        ws = cut(t)
        hit = np.zeros(len(ws), bool)
        for n in sizes:
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in windows:
                    hit[a : a + n] = True
        if not (hit.any() and 20 * hit.sum() >= len(ws)):
            clean[i] = t
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in clean.items():
        ids = own.encode_ordinary(t)
        out.append((i, t, docs[i].lang, docs[i].source, len(t), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_pipeline_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"]
    got, want = sorted(tuple(r) for r in got.collect()), brute(spark)
    assert got == want and 100 < len(got) < 200


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", None, None, 0), (None, "A plain text with the words of this language and no id.", "en", "s", 1), (902, "12 34", "en", "s", 5), (902, "12 34", "en", "s", 5)], docs.schema)
    for rows in (docs.union(odd), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SMALL)
            assert out.columns == docs.columns
            rows = spark.createDataFrame(out.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).count() == rows.count()
    assert rows.count() == 0


def test_rejected_rows_take_no_others_along(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = "A plain text with the words of this language and no id."
    odd = [(None, text, "en", "s", 1), (None, "", "en", "s", 0), (None, None, None, None, None), (903, text, None, "s", 1), (903, "12 34", None, "s", 1), (904, "56 78", "en", None, 1)]
    rows = corpus_pipeline.language_id(spark, docs.union(spark.createDataFrame(odd, docs.schema)), SMALL)
    assert rows.columns == docs.columns
    kept = [tuple(r) for r in rows.collect() if r.doc_id is None or r.doc_id > 900]
    assert sorted(kept, key=str) == sorted([odd[0], odd[3]], key=str)
    assert rows.count() == docs.count() + 2


def test_clashing_columns_and_long_texts(spark):
    """Extra columns with the names of what operators make inside pass through every stage, and so do very long texts."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.limit(30).collect())
    long = rows[0][1] + (" " + rows[1][1]) * (300_000 // max(1, len(rows[1][1])))
    rows += [(5000, long, "en", "s", len(long)), (5001, "x" * 100_000, "en", "s", 100_000)]
    names = ["row", "gone", "_row", "_text", "_id", "_h1", "_drops", "n_lines", "_kept", "id", "node", "spans", "items", "n_words", "n_hit", "ids", "h", "extra0"]
    wide = spark.createDataFrame([(*r, *(f"{n}{i}" for n in names)) for i, r in enumerate(rows)], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + ", ".join(f"`{n}` string" for n in names))
    plain = spark.createDataFrame(rows, docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        wide, plain = stage(spark, wide, SMALL), stage(spark, plain, SMALL)
        extra = [c for c in wide.columns if c in names]
        assert extra == names and sorted(tuple(r) for r in wide.drop(*names).select(*plain.columns).collect()) == sorted(tuple(r) for r in plain.collect()), name
        wide, plain = (spark.createDataFrame(x.collect(), x.schema) for x in (wide, plain))
    assert plain.where("doc_id = 5000").count() == 1 and wide.where("n_lines = concat('n_lines', substring(ids, 4, 9))").count() == wide.count()
