"""Very long texts, very many short ones, and rows without ids."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from inferframe.llm import bm25, langid, quality
from inferframe.llm.line_dedup import line_dedup
from tests.llm.test_dedup import brute_lines


def long_text(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "WORLD", "is", "is", "x1", "a-b!", "é日", "longer" * 5]
    out = " ".join(rng.choice(words) + rng.choice(["", "", "\n", "  "]) for _ in range(n // 5))
    return out[: n - 10] + " end"


@pytest.mark.parametrize("part", [3, 64, 1000])
def test_parts_of_long_texts_lose_nothing(part):
    """Trigrams and features of a text in parts are those of the whole, however small the parts; other rows pass."""
    text = long_text(700_000) + " " + "w" * 5000 + " tail tail"
    text = text[-3000:] if part < 1000 else text
    column = pa.array([text])
    offsets, data = np.array([0, len(text.encode())]), np.frombuffer(text.encode(), np.uint8)
    row, code = langid.trigrams(offsets, data)
    parts = [c for _, n, r, c in langid.coded(column, part) if n == 1 and not r.any()]
    assert len(parts) > 2 and np.array_equal(np.concatenate(parts), code)
    (first, got), *rest = list(quality.feature_rows(column, part))
    assert first == 0 and not rest and np.array_equal(got, quality.features(offsets, data))


def test_texts_of_three_megabytes():
    """The parts that production takes."""
    texts = [long_text(3 << 20), "short text", None]
    column = pa.array(texts)
    whole = [quality.features(np.array([0, len((t or "").encode())]), np.frombuffer((t or "").encode(), np.uint8)) for t in texts]
    assert np.array_equal(np.concatenate([f for _, f in quality.feature_rows(column)]), np.concatenate(whole))
    total = sum(len(code) for _, _, _, code in langid.coded(column))
    assert total == sum(len(langid.trigrams(np.array([0, len((t or "").encode())]), np.frombuffer((t or "").encode(), np.uint8))[0]) for t in texts)


def test_features_of_many_short_rows_are_bounded():
    blocks = [f.shape for _, f in quality.feature_rows(pa.array(["a"] * 5000))]
    assert max(n for n, _ in blocks) <= quality.ROWS and sum(n for n, _ in blocks) == 5000


def test_rows_without_ids_look_up_their_own_lines(spark):
    """5,000 rows without an id and 5,000 shared lines: as by brute force, and in time that follows the rows."""
    lines = [f"shared line number {i} " + "x" * 40 for i in range(5000)]
    rows = [(i, "\n".join(lines[j] for j in range(i % 25, 5000, 25))) for i in range(150)]
    rows += [(None, f"own {i}\n{lines[i]}\n{lines[(i * 7) % 5000]}") for i in range(5000)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = line_dedup(docs).collect()
    assert time.time() - began < 60
    kept = {r.text for r in got if r.doc_id is None}
    assert kept == {f"own {i}" for i in range(5000)} | {""}
    named = [r for r in rows if r[0] is not None]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got if r.doc_id is not None), key=str) == brute_lines(named)


def test_search_over_a_million_one_word_rows(spark):
    """Shards are bounded by rows as well as by bytes."""
    docs = spark.range(1_000_000).selectExpr("id AS doc_id", "CASE WHEN id % 1000 = 7 THEN 'rare' WHEN id % 2 = 0 THEN 'even' ELSE '' END AS text")
    queries = spark.createDataFrame([(1, "rare")], "doc_id long, text string")
    got = [(r["rank"], r.doc_id) for r in bm25.bm25_top_k(docs, queries).orderBy("rank").collect()]
    assert got == [(i + 1, 7 + 1000 * i) for i in range(10)]


def test_order_of_documents_equals_dense_counts():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 40, 300)
    numbers = np.minimum(rng.geometric(0.2, sizes.sum()) - 1, 90)
    got = bm25.Shard.order(numbers, sizes, 91)
    doc, often = np.repeat(np.arange(300), sizes), np.argsort(-np.bincount(numbers, minlength=91), kind="stable")[: bm25.COMMON]
    table = np.zeros((300, 91), np.int64)
    np.add.at(table, (doc, numbers), 1)
    common = [t for t in often if (table[:, t] > 0).sum() * bm25.COMMON_IN > 300]
    assert np.array_equal(got, np.lexsort((sizes, table[:, common].argmax(axis=1))))
