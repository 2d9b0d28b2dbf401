"""Near-duplicates by Jaccard similarity of word shingles, verified on exact sets.

Candidates come from operator 4's SimHash fingerprints by generalised pigeonhole, and beyond its radius from MinHash bands."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import checkpoint_dir, one_of_each
from .simhash import fingerprint, fingerprint_links
from .store import HashStore, write_store
from .textops import NOT_SPACE, distinct_words, expand, mix, texts, window_hashes, words_of

#: Bands, and minima in each: two sets of Jaccard similarity 0.8 share no band with odds (1 - 0.8^4)^24, 3 in a million.
BANDS, ROWS = 24, 4
#: Bits in which fingerprints differ that are candidates by pigeonhole. More make keys and pairs that grow too fast (README).
RADIUS = 6
#: Members up to which buckets are dealt by their least member, so that equal ones meet and are verified once.
FEW = 8
#: Members of a large bucket that candidates for a pivot are compared with.
SAMPLE = 64
#: Shingle hashes of members that are held at once.
HELD = 1 << 21

_RANDOM = np.random.default_rng(42)
_A = _RANDOM.integers(0, 1 << 31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)


def shingled(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(first row, digest of each row's words, first shingle of each row, shingle hashes).

    A text of fewer words has one shingle, its whole sequence; without words none.
    """
    for row, first, number, own in distinct_words(column, NOT_SPACE):
        halves = own.digests()[number]
        n = np.diff(first)
        nodes = [blake2b(halves[a:b].tobytes(), digest_size=16).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        hashes = np.ascontiguousarray(halves[:, 0])
        sizes = np.where(n >= shingle, n - shingle + 1, n > 0)
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(at[-1], np.uint64)
        windows = window_hashes(hashes, shingle)
        whole = n >= shingle
        out[expand(at[:-1][whole], sizes[whole])] = windows[expand(first[:-1][whole], sizes[whole])]
        short = (n > 0) & ~whole
        out[at[:-1][short]] = mix(np.array([int(nodes[i][:16], 16) for i in np.flatnonzero(short)], np.uint64))
        yield row, nodes, at, out


def band_keys(at: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """BANDS keys for each row that has shingles."""
    some = np.flatnonzero(np.diff(at))
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.stack([np.minimum.reduceat(x * a + b, at[some]) for a, b in zip(_A, _B, strict=True)], axis=1) if len(some) else np.zeros((0, BANDS * ROWS), np.uint32)
    wide = least.reshape(len(some), BANDS, ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(some), axis=0)
    for k in range(ROWS):
        keys = mix(keys ^ wide[:, :, k] << np.uint64(8))
    return keys


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, digest, keys, fp) for each row of (id, text); the keys of a text without words are empty."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("digest", T.StringType()), T.StructField("keys", T.BinaryType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys = [], []
            for _, own, at, shingles in shingled(batch.column(1), shingle):
                found = iter(band_keys(at, shingles))
                nodes += own
                keys += [next(found).tobytes() if n else b"" for n in np.diff(at).tolist()]
            fps = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.string()), pa.array(keys, pa.binary()), pa.array(fps)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, in parts that end where column `by` changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        key = columns[by]
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if cut or (held and held[-1][by][-1] != key[0]):
            held.append([c[:cut] for c in columns])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _edges(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, key, node) of the keys that more than one text has."""
    for key, node in _runs(batches, 0):
        cut = _edges(key)
        size = np.diff(cut)
        least = np.minimum.reduceat(node, cut[:-1])
        many = np.repeat(size > 1, size)
        route = np.repeat(np.where(size <= FEW, least, key[cut[:-1]]), size)
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (route, key, node)], names=["route", "key", "node"])


def link_sets(members: np.ndarray, fetch, least: float) -> list[tuple[int, int]]:
    """Links that connect members (sorted) of Jaccard similarity `least` or more as all such pairs would.

    Every member joins the first pivot in reach (any member may be one); only groups whose pivots are
    near enough (the distance obeys the triangle inequality) are compared, until
    one link is found. fetch gives (starts, sizes, values) of sorted members.
    """

    def similar(one: np.ndarray, to: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(to), step):
            starts, sizes, values = fetch(to[a : a + step])
            place = np.searchsorted(one, values)
            place[place == len(one)] = 0
            both = np.add.reduceat(one[place] == values, starts, dtype=np.int64)
            out.append(both / (len(one) + sizes - both))
        return np.concatenate(out)

    def of(member: np.ndarray) -> np.ndarray:
        return fetch(member)[2]

    _, sizes, _ = fetch(members[:64])
    step = max(1, int(HELD // max(1.0, sizes.mean())))
    links, left, groups, reach, pivots = [], members, [], [], []

    def central() -> int:
        """Place of a member of `left` that is near to many: in large buckets the best of a few, by a sample."""
        if len(left) <= 8 * SAMPLE:
            return 0
        sample = np.linspace(0, len(left) - 1, SAMPLE).astype(np.int64)
        near = [int((similar(of(left[i : i + 1]), left[sample]) >= least).sum()) for i in sample[::8].tolist()]
        return int(sample[8 * int(np.argmax(near))])

    while len(left):
        at = central()
        s = similar(of(left[at : at + 1]), left)
        near = s >= least - 1e-12
        near[at] = True
        pivots.append(int(left[at]))
        groups.append(left[near])
        links += [(pivots[-1], int(x)) for x in left[near] if x != pivots[-1]]
        reach.append(left[~near & (s >= 3 * least - 2 - 1e-12)])
        left = left[~near]
    root = list(range(len(groups)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    heads = np.array(pivots)
    for x, g in enumerate(groups):
        if not len(reach[x]):
            continue
        for y in (np.flatnonzero(np.isin(heads[x + 1 :], reach[x])) + x + 1).tolist():
            h = groups[y]
            if top(x) == top(y) or len(g) == len(h) == 1:
                continue
            few, many = (g, h) if len(g) <= len(h) else (h, g)
            for i in range(len(few)):
                near = np.flatnonzero(similar(of(few[i : i + 1]), many) >= least - 1e-12)
                if len(near):
                    links.append((int(few[i]), int(many[near[0]])))
                    root[top(y)] = top(x)
                    break
    return links


def alike(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs of (node, fp) that connect all nodes whose fingerprints differ in at most `radius` bits as all such pairs would.

    Nodes of one fingerprint are paired with their least.
    """
    fps = nodes.groupBy("fp").agg(F.min("node").alias("least")).checkpoint()
    near = fingerprint_links(fps.select("fp"), radius).toDF("x", "y")
    for side, name in (("x", "a"), ("y", "b")):
        near = near.join(fps.select(F.col("fp").alias(f"fp_{name}"), F.col("least").alias(name)), F.col(side) == F.col(f"fp_{name}"))
    same = nodes.join(fps, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return near.select("a", "b").unionByName(same)


def near_dup_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """Returns (id, component_id) for each row of `docs`.

    Words are runs of non-space characters, A-Z in lower case. Texts are linked
    whose sets of word shingles (a shorter text: its whole sequence) have a
    Jaccard similarity of at least `similarity`; texts without words are alike.
    component_id is the smallest id that links reach.

    Texts of equal words (by 128 bits of BLAKE2b over those of the words) collapse first, and get numbers. The distinct ones meet twice: by
    operator 4's fingerprints of the shingles, within `radius` bits by generalised pigeonhole, and by bands of
    MinHash minima, which find what is similar and farther apart. Those that meet any other have their sets of shingles (64-bit hashes of words' digests)
    in the shared folder, and every link is verified there: first the pairs by fingerprints, then the buckets whose members these don't connect already. The table of
    texts is read twice and never shuffled. No digest of two texts is known to be the same; two
    sets of n shingles each share a false one with odds of n * n / 2^64. A pair at 0.8 is missed with odds of 3 in a million, a closer one more rarely.

    Nulls, repeated rows, empty tables and other columns: as in simhash_components.
    """
    spark = docs.sparkSession
    checkpoint_dir(spark)
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = _signatures(narrow, shingle).checkpoint()
    distinct = rows.groupBy("digest").agg(F.min("id").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")).withColumn("number", F.monotonically_increasing_id())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers by a bijection that spreads them over all shards."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(mix(batch.column(4).to_numpy().view(np.uint64)).view(np.int64))], names=["digest", "first", "keys", "fp", "node"])

    # numbers hold once they are written
    distinct = distinct.mapInArrow(spread, T.StructType([distinct.schema["digest"], distinct.schema["first"], distinct.schema["keys"], distinct.schema["fp"], T.StructField("node", T.LongType())])).checkpoint()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(k) // 8 for k in batch.column(1).to_pylist()], np.int64)
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), sizes))], names=["key", "node"])

    met = distinct.select("node", "keys").mapInArrow(keyed, "key long, node long").repartition("key").sortWithinPartitions("key")
    met = met.mapInArrow(_buckets, "route long, key long, node long").checkpoint()
    pairs = alike(distinct.where(F.length("keys") > 0).select("node", "fp"), radius).checkpoint()
    named = distinct.join(met.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct(), "node", "left_semi")
    wanted = write_store(named.select(F.xxhash64("digest").alias("h"), F.col("digest").alias("word"), "node"), "near-dup-nodes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen = HashStore(wanted), set()
        for batch in batches:
            for _, digests, at, shingles in shingled(batch.column(0), shingle):
                words = words_of(pa.array(digests, pa.string()))
                hashes = words.hashes()
                order, nodes, found = np.argsort(hashes, kind="stable"), [], []
                for shard, here, there in store.find(hashes[order], words.take(order)):
                    for place, node in zip(order[here].tolist(), store.array(shard, "node")[there].tolist(), strict=True):
                        if node not in seen:
                            seen.add(node)
                            nodes.append(node)
                            found.append(np.unique(shingles[at[place] : at[place + 1]]).view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int64), *found])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["h", "s"])

    links = spark.createDataFrame([], "a long, b long")
    if sum(wanted.rows):
        stored = write_store(narrow.select("text").mapInArrow(sets, "h long, s array<long>").dropDuplicates(["h"]), "near-dup-sets")

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = HashStore(stored)
            for batch in batches:
                near = []
                for pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    starts, sizes, values = store.lists(np.unique(np.array(pair, np.int64)), "s")
                    both = len(np.intersect1d(values[: sizes[0]], values[starts[1] :], assume_unique=True))
                    near.append(both >= similarity * (sizes.sum() - both) - 1e-12)
                yield batch.filter(pa.array(near, pa.bool_()))

        linked = pairs.repartition("a").mapInArrow(compared, "a long, b long").checkpoint()
        known = connected_components(linked).select(F.col("node").alias("_of"), "root")
        met = met.join(known, F.col("node") == F.col("_of"), "left").select("route", "key", "node", F.coalesce("root", "node").alias("group"))

        def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = HashStore(stored)

            def fetch(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                starts, sizes, values = store.lists(nodes, "s")
                return starts, sizes, values.view(np.uint64)

            for _, key, node, group in _runs(batches, 0):
                cut, out, done = _edges(key), [], set()
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if (group[a:b] == group[a]).all():
                        continue
                    members = np.unique(node[a:b])
                    if (same := members.tobytes()) in done:
                        continue
                    if len(members) <= FEW:
                        done.add(same)
                    out += link_sets(members, fetch, similarity)
                both = np.array(out, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        links = linked.unionByName(met.repartition("route").sortWithinPartitions("route", "key").mapInArrow(verified, "a long, b long"))
    groups = connected_components(links).withColumnRenamed("node", "of")
    labelled = distinct.join(groups, distinct.node == groups.of, "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    # written, so that both sides of the join on roots are plain and a giant component's part can be split
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id")).checkpoint()
    labels = labelled.join(smallest, "root").select(F.col("digest").alias("_of"), "component_id")
    return rows.join(labels, rows.digest == labels["_of"]).select("id", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stand for their group of near-duplicates, as in simhash_dedup; options as in near_dup_components."""
    kept = near_dup_components(docs, id_col, text_col, **options).where(F.col("id") == F.col("component_id")).select(F.col("id").alias("_kept")).distinct()
    return one_of_each(docs.join(kept, docs[id_col] == kept["_kept"], "left_semi"), docs, id_col, text_col).unionByName(docs.where(docs[id_col].isNull()))
