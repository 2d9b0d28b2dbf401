"""Collocations: frequent phrases by growth of projected prefixes, scored by their weakest cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_dup import _runs
from .ngram_lm import Places, _pair_keys, unmix
from .shared import new_folder, small_batches
from .store import Stored, by_shard, count_keys, merge_packets, write_store
from .textops import LOWER, Words, distinct, pieces, words

#: Words of a phrase at most.
LONGEST = 5
#: Keys of word pairs that a shard has at most, about.
SHARD_KEYS = 8 << 20
#: Bytes of distinct words, and projected occurrences, that a task holds before it sends some.
HELD_BYTES, HELD_ROWS = 16 << 20, 1 << 19
#: Occurrences of a prefix beyond which it is grown by one more word before tasks are made of it.
HOT = 1 << 20
#: Parts that a language's phrases are ranked in before its best are.
RANK_PARTS = 64

_BYTE = np.arange(256)
_STOP = np.isin(_BYTE, [*b".,;:!?", 10, 11, 12, 13])
_WORD = ~_STOP & ~np.isin(_BYTE, [32, 9])


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, Words]]:
    """(language, piece of each word, number of each word, the distinct words), for runs of rows of one language."""
    langs = batch.column(0).dictionary_encode()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        for _, offsets, data in pieces(batch.column(1).filter(pa.array(langs.indices.to_numpy() == i))):
            data = LOWER[data]
            starts, ends, first = words(data, offsets, _WORD)
            piece = np.cumsum(_STOP[data])[starts] if len(starts) else starts
            yield lang, piece + np.repeat(np.arange(len(offsets) - 1), np.diff(first)), *distinct(data, starts, ends, _WORD)


def _keyed(own: Words, lang: str) -> Words:
    """The words with a space and their language behind: words have no spaces, so the two stay apart."""
    tail = np.frombuffer(b" " + lang.encode(), np.uint8)
    at = own.at + np.arange(len(own.at)) * len(tail)
    out = np.empty(at[-1], np.uint8)
    behind = np.zeros(len(out), bool)
    behind[(at[1:, None] - len(tail) + np.arange(len(tail))).ravel()] = True
    out[behind], out[~behind] = np.tile(tail, len(own)), own.data
    return Words(at, out)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the distinct keyed words that a task meets, and the number of all words under each language's empty one."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    room = HELD_BYTES

    def merged() -> tuple[pa.Array, np.ndarray]:
        encoded = pa.concat_arrays([x for x, _ in held]).dictionary_encode()
        sums = np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(sums, encoded.indices.to_numpy(), np.concatenate([n for _, n in held]))
        return encoded.dictionary, sums

    for batch in batches:
        for lang, _, number, own in _by_language(batch):
            held.append((_keyed(own, lang).array(), np.bincount(number, minlength=len(own))))
            held.append((pa.array([" " + lang], pa.string()), np.array([len(number)])))
            room -= held[-2][0].nbytes
            if room < 0:
                held = [merged()]
                room = HELD_BYTES - held[0][0].nbytes
                if room < HELD_BYTES // 2:
                    yield pa.RecordBatch.from_arrays([held[0][0], pa.array(held[0][1])], names=["word", "n"])
                    held, room = [], HELD_BYTES
    if held:
        found, counts = merged()
        yield pa.RecordBatch.from_arrays([found, pa.array(counts)], names=["word", "n"])


def _sequence(known: Places, lang: str, piece: np.ndarray, number: np.ndarray, own: Words) -> tuple[np.ndarray, np.ndarray]:
    """The id of each word (-1: not frequent), and whether it and the next are frequent words of one piece."""
    ids = known.known(_keyed(own, lang))[0][number]
    return ids, (ids[:-1] >= 0) & (ids[1:] >= 0) & (piece[1:] == piece[:-1])


def _sum_rows(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of numbers, of which the last is added up where the others are the same; sorted."""
    rows = np.concatenate(parts)
    if not len(rows):
        return rows
    rows = rows[np.lexsort(rows.T[-2::-1])]
    begin = np.flatnonzero(np.concatenate([[True], (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)]))
    out = rows[begin]
    out[:, -1] = np.add.reduceat(rows[:, -1], begin)
    return out


_PROJECTED = ("first", "depth", "w3", "w4", "w5", "n")


def grow(rows: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int, bool]]:
    """Grows a prefix to the right, depth first: yields (words behind it, occurrences, whether these are all).

    rows: (depth, next three words, n), sorted, of all projected occurrences of the prefix; -1 ends one. An
    occurrence set is a range of rows, and an extension a range inside it. Where depth is
    4, this task has only a part of the occurrences of the first extension.
    """
    upto = np.concatenate([[0], np.cumsum(rows[:, -1])])

    def extend(low: int, high: int, level: int, behind: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], int, bool]]:
        word = rows[low:high, level]
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1], [True]])) + low
        n = upto[cut[1:]] - upto[cut[:-1]]
        part = (rows[cut[:-1], 0] > level + 2) & (rows[cut[:-1], level] >= 0)
        for i in np.flatnonzero((rows[cut[:-1], level] >= 0) & ((n >= least) | part)).tolist():
            now = (*behind, int(rows[cut[i], level]))
            yield now, int(n[i]), not part[i]
            if level < LONGEST - 2:
                yield from extend(int(cut[i]), int(cut[i + 1]), level + 1, now)

    if len(rows):
        yield from extend(0, len(rows), 1, ())


class _Names:
    """Words and languages by id."""

    def __init__(self, stored: Stored):
        self.places = Places(stored)

    def of(self, ids: list[tuple[int, ...]]) -> tuple[list[str], list[str], list[int]]:
        """(language, phrase, words of the language) of each sequence of ids, all of whose words are of one language."""
        p, every = self.places, np.unique(np.fromiter((i for x in ids for i in x), np.int64))
        shard = np.searchsorted(p.base, every, side="right") - 1
        names = {}
        for i, s in zip(every.tolist(), shard.tolist(), strict=True):
            at, own = p.array(s, "word-at"), i - int(p.base[s])
            names[i] = p.array(s, "word")[at[own] : at[own + 1]].tobytes().decode().split(" ", 1)
        langs = [names[x[0]][1] for x in ids]
        distinct_langs = sorted(set(langs))
        keys = pa.array([" " + x for x in distinct_langs], pa.string())
        totals = dict(zip(distinct_langs, p.known(next(Words(o, d) for _, o, d in pieces(keys, 1 << 62)), ("n",))[1][0].tolist(), strict=True)) if distinct_langs else {}
        return langs, [" ".join(names[i][0] for i in x) for x in ids], [totals[x] for x in langs]

    def batch(self, ids: list[tuple[int, ...]], counts: list[int], whole: list[bool] | None = None) -> pa.RecordBatch:
        lang, phrase, n = self.of(ids)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(list(map(len, ids)), pa.int32()), pa.array(counts, pa.int64()), pa.array(n, pa.int64()), pa.array(whole or [True] * len(ids))], names=["lang", "phrase", "size", "f", "n", "whole"])


_COUNTED = "lang string, phrase string, size int, f long, n long, whole boolean"


def _stored_words(stored: Stored):
    """The frequent words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names(stored)
        for shard in (s for b in batches for s in b.column(0).to_pylist()):
            for a in range(0, stored.rows[shard], 1 << 14):
                ids = range(a, min(a + (1 << 14), stored.rows[shard]))
                got = names.batch([(i + int(names.places.base[shard]),) for i in ids], names.places.array(shard, "n")[ids.start : ids.stop].tolist())
                yield got.filter(pa.array([x != "" for x in got.column(1).to_pylist()]))

    return run


def _stored_pairs(stored: Stored, pairs: Stored, vocabulary: int):
    """The frequent pairs of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = _Names(stored), Places(pairs)
        for shard in (s for b in batches for s in b.column(0).to_pylist()):
            for a in range(0, pairs.rows[shard], 1 << 14):
                key = unmix(known.array(shard, "h")[a : a + (1 << 14)].view(np.uint64))
                both = np.stack([key // np.uint64(vocabulary + 1), key % np.uint64(vocabulary + 1)], axis=1).astype(np.int64)
                yield names.batch(list(map(tuple, both.tolist())), known.array(shard, "n")[a : a + (1 << 14)].tolist())

    return run


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 100) -> DataFrame:
    """(lang, phrase, size, f, n): every phrase of 1 to 5 words that occurs min_count times in its language, and the language's words.

    A-Z count as lower case. Texts are split at `.,;:!?` and line ends into pieces, these at spaces and
    tabs into words; phrases lie inside a piece, and all their occurrences count. No language is `und`.

    Words are counted, then pairs of frequent words and threes of frequent pairs, and the frequent ones kept as sorted arrays in the
    shared folder. An occurrence of a pair that starts a frequent three is projected: it points at the words behind it, as far as threes
    are frequent (no other phrase can be). Projected occurrences, equal ones added up by each task, go
    to their pair's task, which grows the pair to the right depth first, over ranges of its sorted occurrences. A pair of more than
    HOT occurrences makes a task for each word behind it, and where that may be as frequent for each two;
    then the counts of the three words are added up over the tasks. No task holds more
    than one prefix's occurrences.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = narrow.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    kept = counted.where((F.col("n") >= min_count) | F.col("word").startswith(" "))
    # the number of all words is that of a language's empty word
    stored = write_store(kept.select(F.xxhash64("word").alias("h"), "word", "n"), "phrases-words")
    vocabulary = sum(stored.rows)
    if (vocabulary + 1) ** 2 >= 1 << 64:
        raise ValueError("pairs of over four thousand million frequent words don't fit in 64 bits")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored.sums["n"] // SHARD_KEYS))

    def pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = Places(stored)
        for batch in batches:
            for found in _by_language(batch):
                ids, both = _sequence(known, found[0], *found[1:])
                yield _pair_keys(ids[:-1][both], ids[1:][both], vocabulary)

    def often(table: pa.Table) -> pa.Table:
        _, hashes, counts = merge_packets(table)
        some = counts >= min_count
        return pa.table({"h": hashes[some], "n": counts[some]})

    pairs = write_store(by_shard(count_keys(narrow, pair_keys, shards), shards, often, "h long, n long"), "phrases-pairs", shards)

    def pairs_of(known: Places, known_pairs: Places, found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its id, and the frequent pair that it starts (-1: none) with its occurrences; padded, so that places behind the end exist."""
        ids, both = _sequence(known, found[0], *found[1:])
        at = np.flatnonzero(both)
        keys, of = np.unique(_pair_keys(ids[at], ids[at + 1], vocabulary), return_inverse=True)
        places, (counts,) = known_pairs.look_up(keys, ("n",))
        pair, n = np.full(len(ids) + LONGEST, -1, np.int64), np.zeros(len(ids) + LONGEST, np.int64)
        pair[at], n[at] = places[of], counts[of]
        return np.append(ids, np.full(LONGEST, -1)), pair, n

    def extended(ids: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which two frequent pairs follow each other, and the keys of their three words."""
        at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        return at, _pair_keys(pair[at], ids[at + 2], vocabulary)

    def triple_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known, known_pairs = Places(stored), Places(pairs)
        for batch in batches:
            for found in _by_language(batch):
                ids, pair, _ = pairs_of(known, known_pairs, found)
                yield extended(ids, pair)[1]

    if sum(pairs.rows) * (vocabulary + 1) >= 1 << 64:
        raise ValueError("three words don't fit in 64 bits")
    triples = write_store(by_shard(count_keys(narrow, triple_keys, shards), shards, often, "h long, n long"), "phrases-triples", shards)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_pairs, known_triples = Places(stored), Places(pairs), Places(triples)
        held, room = [np.zeros((0, len(_PROJECTED)), np.int64)], HELD_ROWS

        def sent(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(_PROJECTED))], names=list(_PROJECTED))

        for batch in batches:
            for found in _by_language(batch):
                ids, pair, n = pairs_of(known, known_pairs, found)
                at, keys = extended(ids, pair)
                keys, of = np.unique(keys, return_inverse=True)
                goes = np.zeros(len(ids), bool)
                goes[at] = (known_triples.look_up(keys)[0] >= 0)[of]
                at = np.flatnonzero(goes)
                w4 = np.where(goes[at + 1], ids[at + 3], -1)
                w5 = np.where(goes[at + 1] & goes[at + 2], ids[at + 4], -1)
                depth = 2 + (n[at] > HOT) + ((n[at] > HOT) & (n[at + 1] > HOT))
                held.append(_sum_rows([np.stack([pair[at], depth, ids[at + 2], w4, w5, np.ones(len(at), np.int64)], axis=1)]))
                room -= len(held[-1])
                if room < 0:
                    held = [_sum_rows(held)]
                    room = HELD_ROWS - len(held[0])
                    if room < HELD_ROWS // 2:
                        yield sent(held[0])
                        held, room = [np.zeros((0, len(_PROJECTED)), np.int64)], HELD_ROWS
        yield sent(_sum_rows(held))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known_pairs, out = _Names(stored), Places(pairs), []

        def made() -> pa.RecordBatch:
            return names.batch(*map(list, zip(*out, strict=True))) if out else names.batch([], [], [])

        for columns in _runs(batches, 0):
            rows = np.stack(columns, axis=1)
            cut = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0], [True]]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                before = None
                for behind, f, whole in grow(rows[a:b, 1:], min_count):
                    if before is None:
                        place = int(rows[a, 0])
                        shard = int(np.searchsorted(known_pairs.base, place, side="right")) - 1
                        key = int(unmix(known_pairs.array(shard, "h")[[place - int(known_pairs.base[shard])]].view(np.uint64))[0])
                        before = divmod(key, vocabulary + 1)
                    out.append(((*before, *behind), f, whole))
                if len(out) > 1 << 14:
                    yield made()
                    out.clear()
        yield made()

    schema = ", ".join(f"{c} long" for c in _PROJECTED)
    route = ["first", F.when(F.col("depth") > 2, F.col("w3")), F.when(F.col("depth") > 3, F.col("w4"))]
    dealt = narrow.mapInArrow(project, schema).repartition(*route).sortWithinPartitions("first", "w3", "w4", "w5")
    more = dealt.mapInArrow(grown, _COUNTED)
    every = spark.range(0, len(stored.rows), 1, len(stored.rows)).mapInArrow(_stored_words(stored), _COUNTED)
    every = every.unionByName(spark.range(0, shards, 1, shards).mapInArrow(_stored_pairs(stored, pairs, vocabulary), _COUNTED)).unionByName(more)
    path = new_folder(spark, "phrases")
    every.write.parquet(path)
    counts = spark.read.parquet(path)
    parts = counts.where(~F.col("whole")).groupBy("lang", "phrase", "size", "n").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return counts.where("whole").drop("whole").unionByName(parts)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 100, share: int = 100, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of phrases of 2 to 5 words that occur min_count times in their language.

    a: occurrences, n: the language's words. A cut after the first k words has l and r, the occurrences of what it
    cuts into, and a score of floor(1000 * a * n / (l * r)), exactly; the cut of least score counts, of several the first. A phrase
    is dropped if it lies inside a longer frequent one that has `share` per cent of its
    occurrences or more; then one that is longer by one word has them too, so only those are compared.
    Each language's first `top` (None: all) by score, then a, both falling, then phrase in the order of bytes, with rank from 1.

    A null text has no words, a null language is `und`. Repeated rows all count. An empty
    table gives an empty one. Other columns don't matter.
    """
    counts = frequent_phrases(docs, lang_col, text_col, min_count)
    wide = counts.where("size > 1").withColumn("w", F.split("phrase", " "))

    def part(first, size) -> F.Column:
        return F.array_join(F.slice("w", first, size), " ")

    cuts = wide.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "k", F.col("f").alias("a"), "n", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side in ("left", "right"):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0])), ["lang", side])
    big = {c: F.col(c).cast("decimal(20,0)") for c in "anlr"}
    scored = cuts.withColumns({f"_{c}": v for c, v in big.items()}).withColumn("score", F.expr("1000BD * _a * _n div (_l * _r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    longer = wide.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(F.array_distinct(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the best of each part first, so that no task ranks a whole language
        kept = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
        kept = kept.withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_at") <= top)
    out = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
