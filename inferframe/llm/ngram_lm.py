"""Interpolated modified Kneser-Ney model of two or three words: counted in Spark, sorted hash arrays, mapped by workers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_folder, small_batches
from .store import HashStore, Stored, add_up, by_shard, count_keys, merge_packets, save_column, write_store
from .textops import NOT_SPACE, Words, arrow_columns, distinct_words, mix

#: Keys of pairs (or triples) that a shard has at most, about.
SHARD_KEYS = 8 << 20
#: Bytes of distinct words that a task counts before it sends some.
HELD = 16 << 20


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of textops.mix."""
    x = x.astype(np.uint64, copy=True)
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    x -= np.uint64(0x9E3779B97F4A7C15)
    return x


def discounts(counts_of: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = counts_of
    if not n1 or not n2:
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.0), float(i)) for i, d in enumerate(found)]


@dataclass
class Model:
    """Where the arrays lie, and the few numbers of the whole corpus."""

    words: Stored
    tokens: int
    texts: int
    pairs: Stored | None = None
    bigram_discounts: list[float] | None = None
    word_discounts: list[float] | None = None
    word_backoff: float = 1.0  # mass that continuation counts leave to an even spread
    start_followers: list[int] | None = None  # distinct first words that start 1, 2, and 3 texts or more
    order: int = 2
    triples: Stored | None = None
    trigram_discounts: list[float] | None = None

    @property
    def vocabulary(self) -> int:
        return sum(self.words.rows)

    @property
    def bigrams(self) -> int:
        return sum(self.pairs.rows)


def _tokens(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
    """(first row, first word of each row, number of each word, the distinct words and, last, the empty one for a text's end)."""
    for row, first, number, own in distinct_words(batch.column(batch.schema.get_field_index(name)), NOT_SPACE):
        yield row, first, number, Words(np.append(own.at, own.at[-1]), own.data)


def _sequence(first: np.ndarray, tokens: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token before, token) of each token of each text and its end."""
    n = len(first) - 1
    now = np.full(len(tokens) + n, end, np.int64)
    row = np.repeat(np.arange(n), np.diff(first) + 1)
    now[np.arange(len(tokens)) + np.repeat(np.arange(n), np.diff(first))] = tokens
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[first[:-1] + np.arange(n)] = start
    return row, before, now


class Places(HashStore):
    """The vocabulary (or the pairs): an id is the place among the sorted hashes of all shards."""

    def __init__(self, stored: Stored):
        super().__init__(stored)
        self.base = np.concatenate([[0], np.cumsum(stored.rows)]).astype(np.int64)

    def look_up(self, hashes: np.ndarray, columns: tuple[str, ...] = (), words: Words | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """(ids, columns) of these hashes, or of the words that have them: -1 and 0 for those that aren't there."""
        order = np.argsort(hashes, kind="stable")
        ids, values = np.full(len(hashes), -1, np.int64), [np.zeros((len(hashes), 3) if c == "followers" else len(hashes), np.int64) for c in columns]
        for shard, here, there in self.find(hashes[order], words.take(order) if words else None):
            ids[order[here]] = there + self.base[shard]
            for value, name in zip(values, columns, strict=True):
                stored = self.array(shard, name)
                value[order[here]] = stored.reshape(-1, 3)[there] if name == "followers" else stored[there]
        return ids, values

    def known(self, words: Words, columns: tuple[str, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        return self.look_up(words.hashes(), columns, words)


def _pair_keys(before: np.ndarray, now: np.ndarray, vocabulary: int) -> np.ndarray:
    return mix(before.view(np.uint64) * np.uint64(vocabulary + 1) + now.view(np.uint64)).view(np.int64)


_SENT = "kind string, shard long, ids binary, counts binary"


def _sent(kind: str, ids: np.ndarray, counts: np.ndarray, base: np.ndarray) -> pa.Table:
    """Packets of (places, counts), added up, for the shards that these bases divide ids into."""
    ids, counts = add_up([(ids, counts)])
    cut = np.searchsorted(ids, base)
    some = np.flatnonzero(np.diff(cut))
    packets = [(ids[cut[i] : cut[i + 1]] - base[i], counts[cut[i] : cut[i + 1]]) for i in some]
    return pa.table({"kind": pa.array([kind] * len(some), pa.string()), "shard": pa.array(some, pa.int64()), "ids": pa.array([x.astype(np.uint32).tobytes() for x, _ in packets], pa.binary()), "counts": pa.array([x.astype(np.uint32).tobytes() for _, x in packets], pa.binary())})


def _received(table: pa.Table, size: int, sums: int = 4) -> dict[str, np.ndarray]:
    """The sums of packets by kind, dense; those of kind sums as they are."""
    out: dict[str, np.ndarray] = {}
    for kind, ids, counts in zip(*(table.column(c).to_pylist() for c in ("kind", "ids", "counts")), strict=True):
        if kind == "sums":
            out[kind] = out.get(kind, np.zeros(sums, np.int64)) + np.frombuffer(counts, np.int64)
        else:
            out.setdefault(kind, np.zeros(size, np.uint32))[np.frombuffer(ids, np.uint32)] += np.frombuffer(counts, np.uint32)
    return out


def _sums(shard: int, counts: np.ndarray, more: list[int] | None = None) -> pa.Table:
    """How many counts are 1, 2, 3 and 4, and some more numbers."""
    sums = np.array([*(int((counts == k).sum()) for k in (1, 2, 3, 4)), *(more or [])], np.int64)
    return pa.table({"kind": ["sums"], "shard": pa.array([shard], pa.int64()), "ids": pa.array([b""], pa.binary()), "counts": pa.array([sums.tobytes()], pa.binary())})


def _followers(got: dict[str, np.ndarray], size: int) -> np.ndarray:
    return np.stack([got.get(f"after{k}", np.zeros(size, np.uint32)) for k in (1, 2, 3)], axis=1)


def add_trigrams(docs: DataFrame, model: Model, text_col: str = "text") -> Model:
    """The model of order three: counts trigrams as (id of a pair, id of a word), and what pairs and words need of them.

    A pair's count becomes that of the distinct tokens before it (at the start of
    a text: its own count); how many distinct words follow a pair, and the new
    counts of the pairs that follow a word, go to their shards as in train.
    """
    vocabulary, width = model.vocabulary, np.uint64(model.vocabulary + 1)
    words = model.words._replace(types=model.words.types | {"total": "uint32", "followers": "uint32"})
    pairs = model.pairs._replace(types=model.pairs.types | {"adjusted": "uint32", "followers": "uint32"})
    triples = Stored(shared_folder(docs.sparkSession, "ngram-lm-triples"), [0] * _shards(docs, model.tokens), {"h": "int64", "n": "uint32"})
    base, pair_base = (np.concatenate([[0], np.cumsum(x.rows)]).astype(np.int64) for x in (words, pairs))
    if model.bigrams * (vocabulary + 1) >= 1 << 64:
        raise ValueError("trigrams don't fit in 64 bits")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known, known_pairs = Places(words), Places(pairs)
        for batch in batches:
            for _, first, number, own in _tokens(batch, "text"):
                ids = known.known(own)[0]
                row, before, now = _sequence(first, ids[number], int(ids[-1]), vocabulary)
                some, at = np.unique(_pair_keys(before, now, vocabulary), return_inverse=True)
                pair = known_pairs.look_up(some)[0][at]
                inner = np.flatnonzero(row[1:] == row[:-1])
                yield _pair_keys(pair[inner], now[inner + 1], vocabulary)

    def save_triples(table: pa.Table) -> pa.Table:
        shard, hashes, counts = merge_packets(table)
        save_column(triples, shard, "h", hashes)
        save_column(triples, shard, "n", counts)
        key = unmix(hashes.view(np.uint64))
        pair, now = (key // width).view(np.int64), (key % width).view(np.int64)
        known, middle = Places(pairs), np.zeros(len(pair), np.int64)
        of = np.searchsorted(pair_base, pair, side="right") - 1
        for i in np.unique(of).tolist():
            here = of == i
            middle[here] = (unmix(known.array(i, "h")[pair[here] - pair_base[i]].view(np.uint64)) % width).view(np.int64)
        some, at = np.unique(_pair_keys(middle, now, vocabulary), return_inverse=True)
        out = [_sent("before", known.look_up(some)[0], np.bincount(at, minlength=len(some)), pair_base), _sums(shard % len(pairs.rows), counts), _size("triples", shard, len(hashes), len(pairs.rows))]
        for k in (1, 2, 3):
            own = pair[counts == k if k < 3 else counts >= 3]
            out.append(_sent(f"after{k}", own, np.ones(len(own), np.int64), pair_base))
        return pa.concat_tables(out)

    def save_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        own, passed = _apart(table, "triples", shard % len(words.rows))
        got, size = _received(own, pairs.rows[shard]), pairs.rows[shard]
        out = [passed, pa.table({"kind": ["of triples"], "shard": pa.array([shard % len(words.rows)], pa.int64()), "ids": pa.array([b""], pa.binary()), "counts": pa.array([got.get("sums", np.zeros(4, np.int64)).tobytes()], pa.binary())})]
        if size:
            known = HashStore(pairs)
            before = (unmix(known.array(shard, "h").view(np.uint64)) // width).view(np.int64)
            counts = np.where(before == vocabulary, known.array(shard, "n"), got.get("before", np.zeros(size, np.uint32)))
            save_column(pairs, shard, "adjusted", counts)
            save_column(pairs, shard, "followers", _followers(got, size))
            out += [_sums(shard % len(words.rows), counts), _sent("total", before[before < vocabulary], counts[before < vocabulary].astype(np.int64), base)]
            for k in (1, 2, 3):
                after = before[(before < vocabulary) & (counts == k if k < 3 else counts >= 3)]
                out.append(_sent(f"after{k}", after, np.ones(len(after), np.int64), base))
        return pa.concat_tables(out)

    def save_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        own, sizes = _apart(table, "triples", 0)
        own, of = _apart(own, "of triples", 0)
        got = _received(own, words.rows[shard])
        if words.rows[shard]:
            save_column(words, shard, "total", got.get("total", np.zeros(words.rows[shard], np.uint32)))
            save_column(words, shard, "followers", _followers(got, words.rows[shard]))
        sums = sum((np.frombuffer(x, np.int64) for x in of.column("counts").to_pylist()), np.zeros(4, np.int64))
        return pa.table({"sizes": pa.array([_sizes(sizes)], pa.list_(pa.list_(pa.int64()))), "triples": pa.array([sums.tolist()], pa.list_(pa.int64())), "pairs": pa.array([got.get("sums", np.zeros(4, np.int64)).tolist()], pa.list_(pa.int64()))})

    counted = count_keys(docs.select(F.col(text_col).alias("text")), keys, len(triples.rows))
    sent = by_shard(counted, len(triples.rows), save_triples, _SENT)
    whole = docs.sparkSession.range(len(pairs.rows)).selectExpr("'sums' AS kind", "id AS shard", "binary('') AS ids", "unhex(repeat('00', 32)) AS counts")
    sent = by_shard(sent.union(whole), len(pairs.rows), save_pairs, _SENT)
    rows = by_shard(sent, len(words.rows), save_words, "sizes array<array<long>>, triples array<long>, pairs array<long>").collect()
    for shard, size in (x for r in rows for x in r.sizes):
        triples.rows[shard] = size
    of = {name: [sum(r[name][i] for r in rows) for i in range(4)] for name in ("triples", "pairs")}
    return replace(model, order=3, words=words, pairs=pairs, triples=triples, bigram_discounts=discounts(of["pairs"]), trigram_discounts=discounts(of["triples"]))


def _size(kind: str, shard: int, size: int, shards: int) -> pa.Table:
    """Says, to one of some shards, how many rows a shard has."""
    return pa.table({"kind": [kind], "shard": pa.array([shard % shards], pa.int64()), "ids": pa.array([np.int64(shard).tobytes()], pa.binary()), "counts": pa.array([np.int64(size).tobytes()], pa.binary())})


def _apart(table: pa.Table, kind: str, shard: int) -> tuple[pa.Table, pa.Table]:
    """(other rows, those of this kind with another shard)."""
    is_kind = pc.equal(table.column("kind"), kind)
    some = table.filter(is_kind)
    return table.filter(pc.invert(is_kind)), some.set_column(some.schema.get_field_index("shard"), "shard", pa.array([shard] * some.num_rows, pa.int64()))


def _sizes(table: pa.Table) -> list[list[int]]:
    return [[int(np.frombuffer(x, np.int64)[0]) for x in pair] for pair in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist(), strict=True)]


def _shards(docs: DataFrame, keys: int) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys // SHARD_KEYS))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each distinct word that a task meets, and of the empty one that ends each text."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    room, texts = HELD, 0

    def merged() -> tuple[pa.Array, np.ndarray]:
        encoded = pa.concat_arrays([x for x, _ in held]).dictionary_encode()
        return encoded.dictionary, np.bincount(encoded.indices.to_numpy(), weights=np.concatenate([n for _, n in held]), minlength=len(encoded.dictionary)).astype(np.int64)

    for batch in batches:
        for _, first, number, own in distinct_words(batch.column(0), NOT_SPACE):
            held.append((own.array(), np.bincount(number, minlength=len(own))))
            texts += len(first) - 1
            room -= held[-1][0].nbytes
            if room < 0:
                held = [merged()]
                room = HELD - held[0][0].nbytes
                if room < HELD // 2:
                    yield pa.RecordBatch.from_arrays([held[0][0], pa.array(held[0][1])], names=["word", "n"])
                    held, room = [], HELD
    if texts:
        held.append((pa.array([""], pa.string()), np.array([texts])))
        words, counts = merged()
        yield pa.RecordBatch.from_arrays([words, pa.array(counts)], names=["word", "n"])


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts words, then pairs of word ids, and from the distinct pairs what the model needs.

    Both counts combine on the map side. Words are grouped as they are; pairs meet in shards by hash of their
    ids (a bijection), which are merged, sorted and saved by the task that has them; a frequent word or pair
    is one entry of each packet, and there are as many shards as tokens ask for. How many distinct words follow a word once,
    twice or more, and how many precede it, goes from the pairs' shards to the
    words' shards in the same way. Only a few sums reach the driver, and for each
    shard its size.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(text_col).alias("text"))
    counted = narrow.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = write_store(counted.select(F.xxhash64("word").alias("h"), "word", "n"), "ngram-lm-words")
    vocabulary, tokens = sum(words.rows), words.sums["n"]
    end = Words(np.zeros(2, np.int64), np.zeros(0, np.uint8))
    n_texts = int(Places(words).known(end, ("n",))[1][0][0])
    if (vocabulary + 1) ** 2 >= 1 << 64:
        raise ValueError("pairs of over four thousand million distinct words don't fit in 64 bits")
    words = words._replace(types=words.types | {"preceded": "uint32", "followers": "uint32"})
    pairs = Stored(shared_folder(docs.sparkSession, "ngram-lm-pairs"), [0] * _shards(docs, tokens), {"h": "int64", "n": "uint32"}, {})
    base = np.concatenate([[0], np.cumsum(words.rows)]).astype(np.int64)

    def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = Places(words)
        for batch in batches:
            for _, first, number, own in _tokens(batch, "text"):
                ids = known.known(own)[0]
                _, before, now = _sequence(first, ids[number], int(ids[-1]), vocabulary)
                yield _pair_keys(before, now, vocabulary)

    def save_pairs(table: pa.Table) -> pa.Table:
        shard, hashes, counts = merge_packets(table)
        save_column(pairs, shard, "h", hashes)
        save_column(pairs, shard, "n", counts)
        key = unmix(hashes.view(np.uint64))
        before, now = ((key // np.uint64(vocabulary + 1)).view(np.int64), (key % np.uint64(vocabulary + 1)).view(np.int64))
        out = [_sent("before", now, np.ones(len(now), np.int64), base), _size("pairs", shard, len(hashes), len(words.rows))]
        for k in (1, 2, 3):
            own = before[(before < vocabulary) & (counts == k if k < 3 else counts >= 3)]
            out.append(_sent(f"after{k}", own, np.ones(len(own), np.int64), base))
        starts = [int((before[counts == k if k < 3 else counts >= 3] == vocabulary).sum()) for k in (1, 2, 3)]
        out.append(_sums(shard % len(words.rows), counts, starts))
        return pa.concat_tables(out)

    def save_dense(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        own, sizes = _apart(table, "pairs", 0)
        got, size = _received(own, words.rows[shard], 7), words.rows[shard]
        preceded = got.get("before", np.zeros(size, np.uint32))
        if size:
            save_column(words, shard, "preceded", preceded)
            save_column(words, shard, "followers", _followers(got, size))
        of = [int((preceded == k).sum()) for k in (1, 2, 3, 4)] + [int((preceded >= 3).sum())]
        return pa.table({"sizes": pa.array([_sizes(sizes)], pa.list_(pa.list_(pa.int64()))), "sums": pa.array([got.get("sums", np.zeros(7, np.int64)).tolist()], pa.list_(pa.int64())), "of": pa.array([of], pa.list_(pa.int64()))})

    sent = by_shard(count_keys(narrow, pair_keys, len(pairs.rows)), len(pairs.rows), save_pairs, _SENT)
    rows = by_shard(sent, len(words.rows), save_dense, "sizes array<array<long>>, sums array<long>, of array<long>").collect()
    for shard, size in (x for r in rows for x in r.sizes):
        pairs.rows[shard] = size
    sums = [sum(r["sums"][i] for r in rows) for i in range(7)]
    of = [sum(r["of"][i] for r in rows) for i in range(5)]
    d, n = discounts(of[:4]), sum(pairs.rows)
    backoff = (d[1] * of[0] + d[2] * of[1] + d[3] * of[4]) / n if n else 1.0
    return Model(words, tokens, n_texts, pairs, discounts(sums[:4]), d, backoff, sums[4:7])


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, n_known, base_score and score (log10) to every row, from the memory-mapped arrays."""
    vocabulary, tokens = model.vocabulary, model.tokens
    d2, d1 = np.array(model.bigram_discounts), np.array(model.word_discounts)
    even = model.word_backoff / (vocabulary + 1)
    start_mass = float(np.dot(d2[1:], model.start_followers)) / max(model.texts, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        store, pairs = Places(model.words), Places(model.pairs)
        if model.order == 3:
            triples, d3 = Places(model.triples), np.array(model.trigram_discounts)
        for batch in batches:
            size = batch.num_rows
            n_tokens, n_known, base_score, score = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            for top, first, number, own in _tokens(batch, text_col):
                ids, (n, preceded, followers, total) = store.known(own, ("n", "preceded", "followers", "n" if model.order == 2 else "total"))
                word = np.maximum(preceded - d1[np.minimum(preceded, 3)], 0) / max(model.bigrams, 1) + even
                mass = np.where(total > 0, followers @ d2[1:] / np.maximum(total, 1), 1.0)
                # one more entry: the start of a text
                ids, n, total = np.append(ids, vocabulary), np.append(n, model.texts), np.append(total, model.texts)
                mass = np.append(mass, start_mass if model.texts else 1.0)
                row, before, now = _sequence(first, number, len(own) - 1, len(own))
                known = (ids[before] >= 0) & (ids[now] >= 0)
                key = _pair_keys(ids[before][known], ids[now][known], vocabulary)
                count = np.zeros(len(now), np.int64)
                some, place = np.unique(key, return_inverse=True)
                if model.order == 2:
                    count[known] = pairs.look_up(some, ("n",))[1][0][place]
                else:
                    found, (often, adjusted, after) = pairs.look_up(some, ("n", "adjusted", "followers"))
                    count[known] = adjusted[place]
                p = mass[before] * word[now] + np.maximum(count - d2[np.minimum(count, 3)], 0) / np.maximum(total[before], 1)
                if model.order == 3:
                    pair = np.full(len(now), -1, np.int64)
                    pair[known] = np.where(found >= 0, np.arange(len(found)), -1)[place]
                    at = np.flatnonzero((row[1:] == row[:-1]) & (pair[:-1] >= 0)) + 1
                    context = pair[at - 1]
                    count3, there = np.zeros(len(at), np.int64), ids[now[at]] >= 0
                    some, place = np.unique(_pair_keys(found[context[there]], ids[now[at[there]]], vocabulary), return_inverse=True)
                    count3[there] = triples.look_up(some, ("n",))[1][0][place]
                    p[at] = (np.maximum(count3 - d3[np.minimum(count3, 3)], 0) + after[context] @ d3[1:] * p[at]) / often[context]
                rows = len(first) - 1
                at = slice(top, top + rows)
                c = n[:-1][now]
                n_tokens[at] = np.bincount(row, minlength=rows)
                n_known[at] = np.bincount(row[c > 0], minlength=rows)
                base_score[at] = np.bincount(row, weights=np.log10((c + 0.1) / (tokens + 0.1 * (vocabulary + 1))), minlength=rows)
                score[at] = np.bincount(row, weights=np.log10(p), minlength=rows)
            yield batch, {"n_tokens": n_tokens, "n_known": n_known, "base_score": base_score, "score": score}

    return arrow_columns(docs, run, [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def lm_scores(docs: DataFrame, held_out: Column, text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores every row of `docs` with a model of `order` words (2 or 3) learned from those that aren't held out.

    A-Z in lower case; tokens are the words (runs of non-space characters)
    and one end for each text. Adds held_out, n_tokens, n_known (tokens that
    occur in training), train_tokens, base_score (log10, unigrams with 0.1
    added) and score (log10 probability of the text under the model).

    The model interpolates discounted pair counts with discounted continuation
    counts of words, and those with an even spread over the vocabulary and one
    unknown word. With order 3 it interpolates discounted trigram counts with
    continuation counts of pairs (at the start of a text, where a token has one
    before it, with pair counts). Words are told apart by their bytes. Its arrays lie in the
    shared folder, which must be a mounted file system. More than four thousand
    million distinct words raise ValueError.

    A null or empty text is just its end. A null in held_out counts as held out.
    Repeated rows are trained on and scored each. With no training rows
    every probability is 1. Columns of the new names are replaced. An empty
    table gives an empty one.
    """
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    new = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    flagged = docs.withColumn("_held", F.coalesce(held_out, F.lit(True))).drop(*new).withColumnRenamed("_held", "held_out")
    learned = flagged.where(~F.col("held_out"))
    model = train(learned, text_col)
    if order == 3:
        model = add_trigrams(learned, model, text_col)
    return score_texts(flagged, model, text_col).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
