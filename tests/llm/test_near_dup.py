from collections import defaultdict

import numpy as np

import corpus_pipeline
from inferframe.llm import near_dup

SMALL_WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text, n=5):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1)))


def brute_components(rows, least=0.8):
    """(id, component_id) from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        both = defaultdict(int)
        for g in s:
            for j in where[g]:
                both[j] += 1
            where[g].append(i)
        for j, n in both.items():
            if n >= least * (len(s) + len(sets[j]) - n) - 1e-12:
                root[top(i)] = top(j)
    out = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        out[top(i)].append(doc)
    small = {k: min((d for d in v if d is not None), default=None) for k, v in out.items()}
    return sorted(((doc, small[top(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = "x" + words[at]
    return words


def test_pipeline_stage_equals_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_components(rows)
    assert sorted((tuple(r) for r in near_dup.near_dup_components(docs).collect()), key=str) == want
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect())
    assert kept == sorted(i for i, c in want if i == c) and len(kept) < len(rows) - 50


def test_pairs_about_the_threshold_and_edge_rows(spark):
    rng = np.random.default_rng(3)
    texts = []
    for n in (8, 20, 60, 200, 900):
        for edits in range(1, max(2, n // 20)):
            for _ in range(3):
                words = rng.choice(SMALL_WORDS, n).tolist()
                texts += [" ".join(words), " ".join(edited(rng, words, edits))]
    base = rng.choice(SMALL_WORDS, 150).tolist()
    texts += [" ".join(edited(rng, base, int(e))) for e in rng.integers(1, 8, 120)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5001, None), (5002, ""), (5003, " \t"), (5004, "One two"), (5004, "one two"), (None, "ONE\ntwo"), (None, "alone here"), (5009, "a b c d e " * 20000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    want = brute_components(rows)
    assert 100 < sum(i != c for i, c in want) < len(want) - 100
    assert sorted((tuple(r) for r in near_dup.near_dup_components(docs).collect()), key=str) == want
    assert near_dup.near_dup_components(docs.limit(0)).collect() == []


def test_bands_miss_almost_no_pair():
    rng = np.random.default_rng(4)
    for n in (9, 90, 900):
        sets = rng.integers(0, 1 << 63, (2000, n), dtype=np.int64).astype(np.uint64) * np.uint64(2)
        other = sets.copy()
        other[:, : n // 9] = rng.integers(0, 1 << 63, (2000, n // 9), dtype=np.int64).astype(np.uint64)
        at = np.arange(0, 2001 * n, n)
        one, two = near_dup.band_keys(at, sets.ravel()), near_dup.band_keys(at, other.ravel())
        assert (one == two).any(axis=1).all() and abs((one == two).mean() - 0.8**4) < 0.02


def test_large_buckets_connect_what_all_pairs_would():
    rng = np.random.default_rng(6)
    bases = [np.arange(b * 1000, b * 1000 + 120) for b in range(4)]
    sets = []
    for i in range(900):
        own = bases[min(3, int(rng.exponential(0.7)))].copy()
        edits = rng.choice(120, int(rng.integers(3, 22)), replace=False)
        own[edits] = rng.integers(10_000, 1 << 40, len(edits))
        sets.append(np.unique(own).astype(np.uint64))
    members = np.arange(900) * 3 - 1000

    def fetch(nodes):
        some = [sets[(n + 1000) // 3] for n in nodes.tolist()]
        sizes = np.array([len(x) for x in some])
        return np.cumsum(sizes) - sizes, sizes, np.concatenate(some)

    def components(links):
        root = {int(m): int(m) for m in members}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(top(a), top(b))] = min(top(a), top(b))
        return [top(int(m)) for m in members]

    every = []
    for i in range(900):
        for j in range(i + 1, 900):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if sets[i][0] // 1000 == sets[j][0] // 1000 else 0
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-12:
                every.append((int(members[i]), int(members[j])))
    links = near_dup.link_sets(members, fetch, 0.8)
    assert components(links) == components(every) and len(links) < 3 * 900 < len(every)


def test_candidates_by_fingerprints(spark):
    """Pigeonhole pairs connect what all pairs of fingerprints within the radius would, and the components are the same with any radius."""
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 62, 300)
    fps = np.concatenate([fps, fps[:100], fps[:60] ^ 0b111111, fps[:30] ^ 0b1111111])
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= near_dup.RADIUS).tolist():
            root[max(top(i), top(j))] = min(top(i), top(j))
    want = [top(i) for i in range(len(fps))]
    nodes = spark.createDataFrame(list(enumerate(fps.tolist())), "node long, fp long")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    pairs = near_dup.alike(nodes, near_dup.RADIUS).collect()
    root = list(range(len(fps)))
    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(i) for i in range(len(fps))] == want and len(set(want)) < 310 and len(pairs) < 3 * len(fps)
    words = rng.choice(SMALL_WORDS, 120).tolist()
    rows = [(i, " ".join(edited(rng, words, i % 9))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for radius in (0, 12):
        assert sorted((tuple(r) for r in near_dup.near_dup_components(docs, radius=radius).collect()), key=str) == brute_components(rows)
