import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from inferframe.llm import queries
from inferframe.llm.decontaminate import decontaminate
from inferframe.llm.line_dedup import line_dedup
from inferframe.llm.substring_dedup import substring_dedup

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_bm25_top_k", "op5_substring_dedup", "op8_url_filter", "op9_line_dedup", "op10_decontaminate"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(str(tuple(bool(x) if isinstance(x, bool) else x for x in r)) for r in want.select(*columns).fetchall())


def brute_lines(rows, least=40, docs=5):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        kept, n = [], 0
        for line in (t or "").split("\n"):
            h = {x for x in holders[key(line)] if x is not None}
            if len(key(line)) >= least and len(h) >= docs and i != max(h):
                n += 1
            else:
                kept.append(line)
        out.append((i, "\n".join(kept), len((t or "").split("\n")), n))
    return sorted(out, key=str)


def test_line_edge_rows(spark):
    long, wide = "Shared line " + "x" * 40, "é" * 40
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\n{wide}") for i in range(6)] + [(6, None), (7, ""), (8, long), (8, long), (8, "é" * 39), (None, long), (None, None), (9, "é" * 39), (10, "z" * 100_000 + "\n" + wide), (3, f"again\n{long}")]
    docs = spark.createDataFrame([(i, t, 5, "y") for i, t in rows], "doc_id long, text string, n_lines int, _id string")
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "_id", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup(docs.limit(0)).collect() == []


def brute_windows(rows, n=35):
    seen, texts = {}, [(t or "").replace("\t", " ").replace("\n", " ").split(" ") for _, t in rows]
    texts = [[w for w in ws if w] for ws in texts]
    for k, ws in enumerate(texts):
        for a in range(len(ws) - n + 1):
            seen.setdefault(tuple(ws[a : a + n]), []).append((k, a))
    gone = {(k, p) for places in seen.values() if len(places) > 1 for k, a in places for p in range(a, a + n)}
    out = []
    for k, (i, _) in enumerate(rows):
        kept = [w for p, w in enumerate(texts[k]) if (k, p) not in gone]
        out.append((i, " ".join(kept), len(texts[k]), len(texts[k]) - len(kept)))
    return sorted(out, key=str)


def test_substring_edge_rows(spark):
    import random

    rng = random.Random(4)

    def prose(n):
        return " ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n))

    passage, base = prose(60), prose(300)
    near = base.split(" ")
    near[100] = "changed"
    rows = [(1, prose(50) + " " + passage + "\n" + prose(20)), (2, passage), (3, passage), (4, base), (5, " ".join(near)), (6, "x " * 500), (7, None), (8, ""), (9, prose(34)), (9, prose(34)), (10, prose(35)), (11, "y " * 35), (12, "z " * 36), (None, passage[:200]), (13, passage + " " + passage), (14, prose(40_000)), (4, base)]
    rows += [(15, prose(10) + " " + " ".join(passage.split(" ")[:35]) + " " + prose(3)), (16, " ".join(passage.split(" ")[:34])), (17, "A " + " ".join(w.upper() for w in passage.split(" ")))]
    docs = spark.createDataFrame([(i, t, "c", 3) for i, t in rows], "doc_id long, text string, chunk string, copies int")
    got = substring_dedup(docs, chunk_bytes=2000, derive={"digest": lambda c: F.sha2(c, 256)})
    assert got.columns == ["doc_id", "text", "chunk", "copies", "n_words", "n_removed", "spans", "digest"]
    found = got.collect()
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in found), key=str) == brute_windows(rows)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.digest for r in found)
    assert all(sum(x.last_word - x.first_word + 1 for x in r.spans) == r.n_removed and all(x.last_word - x.first_word >= 34 for x in r.spans) for r in found)
    assert substring_dedup(docs.limit(0)).collect() == []


def test_decontaminate_edge_rows(spark):
    import re

    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:20])), (2, "short one"), (3, None), (4, "..."), (5, " ".join(words[5:18])), (5, " ".join(words[30:])), (None, "lonely ITEM here")]
    texts = [" ".join(words), "x " + " ".join(words[3:17]).upper() + " y", " ".join(words[7:19]), None, "", "A short, one! " * 3 + "é", "the lonely item here " + "pad " * 300, "short " * 30 + "one", " ".join(words[:13]) + " | " + " ".join(words[1:14]), "pad " * 50_000 + " ".join(words[5:18])]
    rows = [*enumerate(texts), (2, texts[1]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, spans string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    windows = []
    for i, t in items:
        ws = cut(t)
        windows += [("null" if i is None else str(i), ws[a : a + 13]) for a in range(max(1, len(ws) - 12)) if ws]
    want = []
    for i, t in rows:
        ws, hit, found = cut(t), set(), set()
        for item, w in windows:
            for a in range(len(ws) - len(w) + 1):
                if ws[a] == w[0] and ws[a : a + len(w)] == w:
                    hit |= set(range(a, a + len(w)))
                    found.add(item)
        want.append((i, len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws)))
    for options in ({}, {"block_bytes": 120, "shard_bytes": 300}):
        got = decontaminate(docs, benchmark, **options).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == sorted(want, key=str)
        for r in got:
            for s in r.spans:
                assert len(cut((r.text.encode()[s.start : s.end]).decode())) == s.last_word - s.first_word + 1
    assert decontaminate(docs.limit(0), benchmark).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate(docs, benchmark.limit(0)).collect())
