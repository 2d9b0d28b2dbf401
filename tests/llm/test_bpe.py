import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from inferframe.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(text, own):
    ids = own.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table(spark):
    own = reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: expected(t, own) for i, t in texts.items()}


def test_edge_rows(spark):
    own = reference()
    rng = random.Random(3)
    odd = [None, "", " ", "a", "a", "  \n\n x  ", "\x1c\x85  　 x", "ab" * 40, "x" * 5000, "\U0001f600́é", "don't I'LL we've", "١٢٣ 12³", "".join(rng.choice("aeé日本\t!?0 ' ") for _ in range(3000)), "é" * 33, "<|endoftext|>"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(odd)], "doc_id long, text string, ids int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.bpe_columns(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {i: expected(t, own) for i, t in enumerate(odd)}
    assert queries.bpe_columns(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_long_words():
    own, ranks, rng = reference(), bpe.read_ranks(PATH), random.Random(5)
    for n in (1, 2, 7, 70, 900):
        for alphabet in ("ab", "aehilnorst", "é日"):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            assert bpe.encode_long(word.encode(), ranks) == own.encode_single_piece(word.encode()) if hasattr(own, "encode_single_piece") else own.encode_ordinary(word)


def test_splitting_equals_the_pattern():
    import numpy as np
    import pyarrow as pa

    from inferframe.llm import pretokenize, textops

    assert pretokenize.PATTERN == public_tokenizers.PATTERN
    rng = random.Random(7)
    alphabet = ["'", " ", "\n", "s", "t", "re", "ve", "ll", "d", "m", "a", "é", "1", "²", "!", "-", "\u00a0", "\t", "日", "\U0001f600", "x"]
    texts = [None, ""] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(9))) for _ in range(20_000)] + ["word " * 200_000]
    fast, slow = pretokenize.splitter_of(public_tokenizers.PATTERN), pretokenize.splitter_of("(?:" + public_tokenizers.PATTERN + ")")
    for _, offsets, data in textops.pieces(pa.array(texts)):
        assert np.array_equal(fast(offsets, data), slow(offsets, data))
