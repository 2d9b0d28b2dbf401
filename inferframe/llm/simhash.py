"""SimHash near-duplicates: fingerprints, and links by generalised pigeonhole."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import checkpoint_dir, one_of_each
from .textops import texts

BITS = 64
_LANES = 256 * np.arange(8)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Cost of a key row, in pairs compared: a shuffled and sorted row against one exclusive-or of a block.
ROW_COST = 100


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles (repeats count); 0 without words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > shingle:
        starts, ends = starts[: len(parts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(2048, np.int64)
    for i in range(0, len(starts), 65536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + 65536].tolist(), ends[i : i + 65536].tolist(), strict=True)], dtype=np.uint64)
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) for each row, fp as a signed long."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in texts(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return narrow.mapInArrow(run, schema)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each two bits how many have both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(v), 65536):
                bits = np.unpackbits(np.ascontiguousarray(v[a : a + 65536]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(v)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total[i, j], n))], names=["i", "j", "c"])

    rows = fps.mapInArrow(run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    n, both = 0, np.zeros((BITS, BITS), np.int64)
    for i, j, c in rows:
        if i < 0:
            n = c
        else:
            both[i, j] = both[j, i] = c
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Splits the bits into m parts of like width, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, parts = set(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        among = sorted(left)
        part = [max(among, key=lambda b: (related[b, among].sum(), -b))]
        while len(part) < width:
            part.append(max(sorted(left - {*part}), key=lambda b: (related[b, part].sum(), -b)))
        parts.append(sorted(part))
        left -= {*part}
    return parts


def _at_most(differs: np.ndarray, most: int) -> list[float]:
    """P(at most t of these independent bits differ), t from 0 to most."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for q in differs:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist[: most + 1]).tolist()


def allocate(n: int, both: np.ndarray, max_distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is probed.

    By the pigeonhole principle, of two fingerprints within max_distance some
    part i differs in at most t_i bits if the t_i sum to max_distance - m + 1
    (a part of -1 is never probed). For each number of parts, dynamic
    programming takes the thresholds of least cost: key rows, and candidate
    pairs estimated from all fingerprints' bit counts.
    """
    p = np.diag(both) / max(n, 1)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(1, max_distance + 2):
        parts, total = group_bits(n, both, m), max_distance - m + 1
        plans: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            share = _at_most(2 * p[part] * (1 - p[part]), max_distance)
            costs = {-1: 0.0}
            for t in range(max_distance + 1):
                rows = n * (1 + sum(math.comb(len(part), i) for i in range(1, t + 1)))
                costs[t] = ROW_COST * rows + n * n / 2 * share[t]
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in plans.items():
                for t, c in costs.items():
                    if used + t + 1 <= total + m and (used + t + 1 not in after or cost + c < after[used + t + 1][0]):
                        after[used + t + 1] = cost + c, [*ts, t]
            plans = after
        cost, ts = plans[total + m]
        if best is None or cost < best[0]:
            best = cost, [(part, t) for part, t in zip(parts, ts, strict=True) if t >= 0]
    return best[1]


def _pick(v: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(v), np.uint64)
    for k, b in enumerate(bits):
        out |= ((v >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _flips(width: int, t: int) -> list[int]:
    """Masks of 1 to t bits."""
    masks, last = [0], [0]
    for _ in range(t):
        last = [x | 1 << b for x in last for b in range(x.bit_length(), width)]
        masks += last
    return masks


def probe(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp): each fingerprint under its own value of each part and the values near it.

    Of two values that differ, only the smaller one probes the larger one's key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (bits, t) in enumerate(parts):
                own, top = _pick(v, bits), np.uint64(k) << np.uint64(60)
                if len(bits) > 60:
                    own, top = v, np.uint64(0)
                for mask in _flips(len(bits), t):
                    key = own ^ np.uint64(mask)
                    some = key >= own
                    yield pa.RecordBatch.from_arrays([pa.array((key[some] | top).view(np.int64)), pa.array(v[some].view(np.int64))], names=["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def link_bucket(v: np.ndarray, most: int) -> np.ndarray:
    """Links (pairs of places) that connect all of v within `most` bits as all pairs would; a few for each entry.

    Blocks of all pairs, while these give few links; else every entry joins the
    first pivot in reach, and only groups whose pivots are near are compared,
    until one link is found.
    """
    n = len(v)
    found, room = [], 4 * n + 64
    for a in range(0, n, 512):
        near = np.bitwise_count(v[a : a + 512, None] ^ v[None, a:]) <= most
        i, j = np.nonzero(np.triu(near, 1))
        found.append(np.stack([i + a, j + a], axis=1))
        room -= len(i)
        if room < 0:
            break
    else:
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    links, left, groups = [], np.arange(n), []
    while len(left):
        near = np.bitwise_count(v[left] ^ v[left[0]]) <= most
        group, left = left[near], left[~near]
        links.append(np.stack([np.full(len(group) - 1, group[0]), group[1:]], axis=1))
        groups.append(group)
    root = list(range(len(groups)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pivots = v[[g[0] for g in groups]]
    for x in range(len(groups)):
        for y in np.flatnonzero(np.bitwise_count(pivots[x + 1 :] ^ pivots[x]) <= 3 * most) + x + 1:
            if top(x) == top(int(y)):
                continue
            g, h = groups[x], groups[y]
            for a in range(0, len(g), 512):
                near = np.argwhere(np.bitwise_count(v[g[a : a + 512], None] ^ v[None, h]) <= most)
                if len(near):
                    links.append(np.array([[g[a + near[0][0]], h[near[0][1]]]]))
                    root[top(int(y))] = top(x)
                    break
    return np.concatenate(links)


def _verify(most: int):
    def edges(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        pairs = size == 2
        a = cut[:-1][pairs]
        near = a[np.bitwise_count(fp[a] ^ fp[a + 1]) <= most]
        out = [np.stack([fp[near], fp[near + 1]], axis=1)]
        for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            v = fp[a : a + n]
            if len(found := link_bucket(v, most)):
                out.append(v[found])
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
            if not len(key):
                continue
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if cut or (held and held[-1][0][-1] != key[0]):
                held.append((key[:cut], fp[:cut]))
                yield _links(edges(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield _links(edges(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def _links(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["a", "b"])


def fingerprint_links(nodes: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): links that connect distinct fingerprints (fp) within max_distance bits as all such pairs would, by generalised pigeonhole."""
    n, both = bit_counts(nodes)
    parts = allocate(n, both, max_distance) if n else []
    keyed = probe(nodes, parts) if n else nodes.selectExpr("fp AS key", "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    return keyed.mapInArrow(_verify(max_distance), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, max_distance: int = 4) -> DataFrame:
    """Returns (id, fingerprint, component_id) for each row of `docs`.

    Words are runs of non-space characters, A-Z in lower case. A fingerprint
    bit is set if it is in over half of the XXH64 of the word shingles (a
    shorter text: its whole sequence; without words: zero). Fingerprints that
    differ in at most `max_distance` bits are linked; component_id is the
    smallest id that links reach.

    Equal fingerprints collapse first. The distinct ones are keyed as
    `allocate` says, each key's are compared in one place and verified, and
    only links that connect them go on. Texts are read once; the narrow table of
    fingerprints is cut by checkpoint().

    Nulls: a null text has fingerprint zero; a row with a null id takes part in
    links but is never a component_id (null if its group has no id). Repeated
    rows each get a row. An empty table gives an empty one. Other columns of
    `docs` play no part.
    """
    checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, id_col, text_col, shingle, seed).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("id").alias("first")).checkpoint()
    groups = connected_components(fingerprint_links(distinct.select("fp"), max_distance))
    labelled = distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # written, so that both sides of the join on roots are plain and a giant component's part can be split
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id")).checkpoint()
    labels = labelled.join(smallest, "root").select(F.col("fp").alias("of"), "component_id")
    return rows.join(labels, rows.fp == labels.of).select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stand for their group of near-duplicates: those with its smallest id.

    Options as in simhash_components. Repeated rows with one id leave one, that with the least digest of its text.
    Rows with a null id can't be told apart and stay.
    """
    kept = simhash_components(docs, id_col, text_col, **options).where(F.col("id") == F.col("component_id")).select(F.col("id").alias("_kept")).distinct()
    return one_of_each(docs.join(kept, docs[id_col] == kept["_kept"], "left_semi"), docs, id_col, text_col).unionByName(docs.where(docs[id_col].isNull()))
