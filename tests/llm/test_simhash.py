import numpy as np
import xxhash

from inferframe.llm import simhash


def brute_fingerprint(text, n=4):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, most=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array(fps, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= most).tolist():
            root[top(j)] = top(i)
    out = {}
    for i, (doc, _) in enumerate(rows):
        out.setdefault(top(i), []).append(doc)
    small = {k: min((d for d in v if d is not None), default=None) for k, v in out.items()}
    return sorted(((doc, f"{fps[i]:016x}", small[top(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str)
    want = brute_components(rows)
    assert got == want
    assert sum(r[0] != r[2] for r in want) > 20


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "one"), (4, "one"), (None, "ONE"), (None, "alone here"), (9, "a b c d e " * 20000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == brute_components(rows)
    assert simhash.simhash_components(docs.limit(0)).collect() == []
    kept = simhash.simhash_dedup(docs).select("doc_id").collect()
    assert sorted((r[0] for r in kept), key=str) == sorted([1, 4, 9, None, None], key=str)


def test_links_connect_as_all_pairs():
    rng = np.random.default_rng(1)
    for spread, n in ((2, 700), (6, 900), (64, 300)):
        v = np.full(n, 0x0123456789ABCDEF, np.uint64)
        for _ in range(spread):
            v ^= np.uint64(1) << rng.integers(0, 20 if spread < 64 else 64, n).astype(np.uint64)
        v = np.unique(v)
        links = simhash.link_bucket(v, 4)
        assert (np.bitwise_count(v[links[:, 0]] ^ v[links[:, 1]]) <= 4).all()
        labels = {}
        for name, pairs in (("all", np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4)), ("some", links)):
            label = np.arange(len(v))
            while True:
                new = label.copy()
                np.minimum.at(new, pairs[:, 0], label[pairs[:, 1]])
                np.minimum.at(new, pairs[:, 1], label[pairs[:, 0]])
                if (new == label).all():
                    break
                label = new
            labels[name] = label
        assert (labels["all"] == labels["some"]).all()


def test_pigeonhole_loses_no_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    near = base.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    v = np.unique(np.concatenate([base, near]))
    bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    fps = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    n, both = simhash.bit_counts(fps)
    assert n == len(v) and (both == bits.T @ bits).all()
    want = {(int(v[i]), int(v[j])) for i, j in np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4) if i < j}
    for size in (n, 10**6, 10**8):
        parts = simhash.allocate(size, both * (size // n) if size > n else both, 4)
        keyed = simhash.probe(fps, parts).repartition(3, "key").sortWithinPartitions("key")
        got = {tuple(sorted((r[0] & (1 << 64) - 1, r[1] & (1 << 64) - 1))) for r in keyed.mapInArrow(simhash._verify(4), "a long, b long").collect()}
        assert want <= got | {(a, b) for a, b in want if a == b} and got <= want
