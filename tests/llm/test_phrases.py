import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from inferframe.llm import phrases
from inferframe.llm.phrases import collocations, frequent_phrases
from inferframe.llm.queries import OP12_SQL, op12_collocations
from tests.conftest import SF


def plain(rows, least, share=100, top=2000):
    """Collocations of (lang, text) rows by dictionaries of all phrases."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for size in range(1, 6):
                counts[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, c in counts.items():
        found = []
        for p, a in c.items():
            if a < least or len(p) < 2:
                continue
            inside = (q for q in c if len(q) > len(p) and c[q] >= least and 100 * c[q] >= share * a)
            if any(q[i : i + len(p)] == p for q in inside for i in range(len(q) - len(p) + 1)):
                continue
            score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def some_rows(n=400, seed=5):
    rng = random.Random(seed)
    vocabulary = ["A", "b", "c", "dé", "x'y", "zz"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(vocabulary) + rng.choice(["  ", " ", " ", "\t", ", ", "\n", "\r"]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, None), ("fr", "!!"), ("l x", "a a a a a a a " * 30)] + [("en", "New York City is big")] * 12


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("least", "share", "top"), [(12, 100, 2000), (12, 60, 5), (30, 100, None)])
def test_equals_plain_version(spark, least, share, top):
    """Nulls, ties, repeated rows, languages in one part, overlapping occurrences, other columns of the same names."""
    rows = some_rows()
    docs = spark.createDataFrame([(x, t, 1, 2) for x, t in rows], "lang string, text string, n long, rank long").repartition(3)
    assert got(collocations(docs, min_count=least, share=share, top=top)) == plain(rows, least, share, top)


def test_hot_prefixes_are_split(spark, monkeypatch):
    """Prefixes of three and four words for tasks, small packets, small parts: the same result."""
    rows = some_rows(600, 6)
    want = plain(rows, 10)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for hot in (50, 0):
        monkeypatch.setattr(phrases, "HOT", hot)
        monkeypatch.setattr(phrases, "HELD_ROWS", 16)
        monkeypatch.setattr(phrases, "HELD_BYTES", 64)
        assert got(collocations(docs, min_count=10)) == want


def test_very_long_text_and_counts(spark):
    text = "the quick fox " * 60000
    found = {r.phrase: (r.f, r.n) for r in frequent_phrases(spark.createDataFrame([("en", text)], "lang string, text string")).collect()}
    assert found["the quick fox the quick"] == (59999, 180000) and found["fox"] == (60000, 180000) and len(found) == 15


def test_exact_beyond_64_bits(spark):
    """1000 * a * n passes 64 bits."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(*(F.lit(v).cast("decimal(20,0)").alias(k) for k, v in (("_a", 10**12 + 7), ("_n", 10**13 + 9), ("_l", 10**12 + 11), ("_r", 10**12 + 13))))
    assert row.select(F.expr("1000BD * _a * _n div (_l * _r)").alias("s")).first().s == 1000 * (10**12 + 7) * (10**13 + 9) // ((10**12 + 11) * (10**12 + 13))


def test_empty_tables(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(SF, 'documents.parquet')}'")
    want = sorted(c.sql(OP12_SQL).fetchall())
    assert got(op12_collocations(spark, SF)) == want and len(want) > 50
