import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inferframe.llm import align
from inferframe.llm.align import Aligner, align_tokenizers, byte_letters
from inferframe.llm.queries import op13_token_alignment
from tests.conftest import SMALL

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_text(tokenizers, text):
    """(A ids, B ids, groups of one text as pairs of lists) by the whole text at once, or None."""
    a_of, b_of = tokenizers
    if not text:
        return None
    letters = byte_letters()
    a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
    a_bytes = [bytes(letters[c] for c in a_of.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    a_end, b_end = (dict(zip(np.cumsum([len(x) for x in bs]).tolist(), range(1, len(bs) + 1), strict=True)) for bs in (a_bytes, b_bytes))
    groups, i, j = [], 0, 0
    for end in sorted(a_end.keys() & b_end.keys()):
        groups.append((a[i : a_end[end]], b[j : b_end[end]]))
        i, j = a_end[end], b_end[end]
    return a, b, groups


def plain_rows(tokenizers, texts):
    found = [plain_text(tokenizers, t) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for f in found if f for g in f[2])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in f[2]]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in f[2])
        out.append((len(f[0]), len(f[1]), len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts(n=400):
    rng = random.Random(3)
    parts = [*"ab cd  .,'s\n\t▁é世 <|>࢏́\x00\x7f", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "<unk>", "'s", "   ", " \n", "　", "😀", "ﬁ", "naïve", " Straße"]
    return [None, "", " ", "\n", "a", "a b", " a b ", "▁"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_rows_equal_whole_text_encoding(spark, tokenizers):
    """Nulls, empty texts, odd characters, repeated rows and ids, a very long text and a very long word, clashing columns."""
    texts = odd_texts() * 2 + ["la la " * 60000, "x" * 20000, "été " * 5000]
    rows = [(None if i % 50 == 0 else i // 3, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs string").withColumn("n_a", F.lit(1)).repartition(5)
    got = align_tokenizers(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got.collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, plain_rows(tokenizers, texts), strict=True))


def test_query_equals_plain_version(spark, tokenizers):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op13_token_alignment(spark, SMALL).collect()}
    assert got == {d.doc_id: x for d, x in zip(docs, plain_rows(tokenizers, [d.text for d in docs]), strict=True)}
    assert sum(x[0] > 0 for x in got.values()) > 150


def test_hot_bucket_takes_many_slots(spark, tokenizers, monkeypatch):
    """A third of all links to one B id, over more slots than one: the same figures."""
    monkeypatch.setattr(align, "SLOT_BYTES", 600)
    monkeypatch.setattr(align, "HELD", 8)
    texts = ["the the cat " + str(i) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align_tokenizers(docs, A, B).collect()}
    assert got == dict(enumerate(plain_rows(tokenizers, texts)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(docs, A, B).count() == 0


def test_ranked_way_equals_library_for_all_letters_it_takes(tokenizers):
    """Every character below the bound, in places where classes matter."""
    own = Aligner(A, B)
    chunks = [f.replace("c", chr(i)) for i in range(1, ord(align.AGREED)) for f in ("c's", "1c2", "ccX", "xc c", "c\n c", "c1")]
    fast = [own.ranked.encode_ordinary(" " + c) for c in chunks]
    assert fast == [x.ids for x in tokenizers[0].encode_batch([" " + c for c in chunks], add_special_tokens=False)]


def test_pieces_of_a_batch(tokenizers, monkeypatch):
    """A batch that is worked on in many pieces gives each row its own figures."""
    texts = odd_texts(60)
    whole = list(Aligner(A, B).texts(pa.array(texts)))
    monkeypatch.setattr(align, "ENCODED", 40)
    parts = list(Aligner(A, B).texts(pa.array(texts)))
    assert len(parts) > 10
    for k in ("n_a", "n_b", "n_links", "groups_sha256", "pairs", "times"):
        assert [x for d in whole for x in d[k]] == [x for d in parts for x in d[k]]
