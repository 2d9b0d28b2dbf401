"""Removal of word passages that occur more than once: winnowed anchors as seeds, whose extensions both ways are compared."""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches
from .textops import NOT_SPACE, distinct_words, window_hashes

_PACKET = "bucket long, chunk long, hashes binary, flags binary"
_MANY, _ASKS = 1, 2
#: Text of a part at most, about; there are more parts than shuffle partitions where the texts ask for them.
PART_BYTES = 64 << 20
SPANS = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("first_word", "last_word")]))
_SPANS_ARROW = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))


def _slide(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """better.reduce of each `width` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out = better(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = better(out[: len(out) - (width - have)], out[width - have :])
    return out


class Chunk:
    """Words of some whole texts: their hashes, the windows inside one text, and the winnowed anchors.

    An anchor has k words, the least hash of each `length - k + 1` in a row, so
    every window of `length` words holds one, and equal windows hold the same.
    """

    def __init__(self, table: pa.Table | pa.RecordBatch, length: int, k: int, key: tuple[int, ...]):
        column = table.column(table.schema.get_field_index("text"))
        copies = table.column(table.schema.get_field_index("copies")).to_numpy()
        hashes, firsts, n = [np.zeros((0, 2), np.uint64)], [np.zeros(1, np.int64)], 0
        for _, first, number, own in distinct_words(column, NOT_SPACE, lower=False):
            hashes.append(own.keyed(key)[number])
            firsts.append(first[1:] + n)
            n += len(number)
        self.length, self.k, self.key = length, k, key
        self.first = np.concatenate(firsts)
        #: of each word, the halves of its 128 bits
        self.hashes = np.concatenate(hashes)
        row = np.repeat(np.arange(len(copies)), np.diff(self.first))
        windows = max(0, n - length + 1)
        #: of each window start, whether its window ends in the same text
        self.whole = row[:windows] == row[length - 1 :] if windows else np.zeros(0, bool)
        #: of each window start, whether its text has copies, which repeat all its windows
        self.copied = (copies > 1)[row[:windows]] & self.whole

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-grams at window starts and beyond, and which of them are anchors."""
        grams = window_hashes(self.hashes[:, 0], self.k)
        if not len(self.whole):
            return grams, np.zeros(len(grams), bool)
        span = self.length - self.k + 1
        grams = np.maximum(grams, np.uint64(1))
        least = np.where(self.whole, _slide(grams, span, np.minimum), np.uint64(0))
        padded = np.zeros(len(grams) + span - 1, np.uint64)
        padded[span - 1 : span - 1 + len(least)] = least
        return grams, _slide(padded, span, np.maximum) == grams

    def windows(self) -> np.ndarray:
        """Two hashes of each window, one of either half of its words' bits, by factors of the key."""
        return np.stack([window_hashes(self.hashes[:, i], self.length, self.key[i]) for i in range(2)], axis=1)

    def near(self, anchors: np.ndarray) -> np.ndarray:
        """Window starts whose window holds one of these anchor places."""
        n, span = len(self.whole), self.length - self.k + 1
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, np.maximum(anchors - span + 1, 0).clip(max=n), 1)
        np.add.at(edge, (anchors + 1).clip(max=n), -1)
        return (np.cumsum(edge)[:n] > 0) & self.whole


def _in_order(keys: np.ndarray) -> np.ndarray:
    """An order of the rows of `keys` (one or two columns) in which equal rows lie together, by the first column."""
    order = np.argsort(keys[:, 0], kind="stable")
    now = keys[order]
    if keys.shape[1] > 1 and ((now[1:, 0] == now[:-1, 0]) & (now[1:, 1] != now[:-1, 1])).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))
    return order


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)


def _packets(chunk: int, buckets: int, keys: np.ndarray, many: np.ndarray, asks: np.ndarray) -> pa.Table:
    """The distinct keys of one chunk for each bucket, with flags: occurs more than once, wants an answer."""
    order = _in_order(keys)
    keys, many, asks = keys[order], many[order], asks[order]
    begin = _begins(keys)
    flags = np.zeros(len(begin), np.uint8)
    if len(begin):
        flags |= np.where((np.diff(np.append(begin, len(keys))) > 1) | np.logical_or.reduceat(many, begin), _MANY, 0).astype(np.uint8)
        flags |= np.where(np.logical_or.reduceat(asks, begin), _ASKS, 0).astype(np.uint8)
    keys = keys[begin]
    bucket = _bucket(keys[:, 0], buckets)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(bucket))
    return pa.table(
        {"bucket": pa.array(bucket[cut]), "chunk": pa.array(np.full(len(cut), chunk, np.int64)), "hashes": pa.array([keys[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary()), "flags": pa.array([flags[a:b].tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary())}
    )


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by range, so that they are in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _answers(packets: DataFrame, buckets: int, width: int) -> DataFrame:
    """(chunk, repeated): for each chunk that asks, its keys (of `width` hashes) that occur more than once in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = [np.frombuffer(x, np.uint64).reshape(-1, width) for x in table.column("hashes").to_pylist()]
        flags = np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8)
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) for x in keys])
        every = np.concatenate(keys)
        order = _in_order(every)
        every, flags, chunk = every[order], flags[order], chunk[order]
        begin = _begins(every)
        sizes = np.diff(np.append(begin, len(every)))
        repeated = np.repeat((sizes > 1) | (np.bitwise_or.reduceat(flags, begin) & _MANY > 0), sizes)
        some = repeated & (flags & _ASKS > 0)
        every, chunk = every[some], chunk[some]
        order = np.argsort(chunk, kind="stable")
        every, chunk = every[order], chunk[order]
        cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(chunk[cut]), pa.array([every[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(chunk)), strict=False)], pa.binary())], names=["chunk", "repeated"])

    return packets.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(run, "chunk long, repeated binary")


def _among(values: np.ndarray, table: pa.Table) -> np.ndarray:
    """Which rows of values are in the answers to a chunk."""
    width = values.shape[1]
    known = np.frombuffer(b"".join(table.column("repeated").to_pylist()), np.uint64).reshape(-1, width)
    known = known[_in_order(known)]
    out, left, place = np.zeros(len(values), bool), np.arange(len(values)), np.searchsorted(known[:, 0], values[:, 0])
    while len(left):
        left = left[place[left] < len(known)]
        left = left[known[place[left], 0] == values[left, 0]]
        same = (known[place[left]] == values[left]).all(axis=1)
        out[left[same]] = True
        left = left[~same]
        place[left] += 1
    return out


def _spans(removed: np.ndarray) -> list[dict]:
    """Runs of removed words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]]))).reshape(-1, 2)
    return [{"first_word": a, "last_word": b - 1} for a, b in edge.tolist()]


def substring_dedup(docs: DataFrame, text_col: str = "text", length: int = 35, anchor: int = 12, derive: dict[str, Callable[[Column], Column]] | None = None, keep_text: bool = True, chunk_bytes: int = 2 << 20) -> DataFrame:
    """Removes each word covered by a window of `length` words that also starts anywhere else.

    Words are runs of non-space characters, unchanged; the kept words are
    joined by one space. Returns the rows of `docs` with `text_col` replaced by
    the kept words (left out if not keep_text) and with n_words, n_removed, spans
    (first and last word of each removed run) and the columns of `derive` (each made
    from the kept words, once for each distinct text); columns of these names are replaced.

    Equal texts collapse to one with a count. The distinct texts are dealt into
    chunks of about `chunk_bytes`. Each chunk sends its distinct anchors to
    buckets by hash, which answer with those that occur elsewhere (the seeds).
    An extension of a seed is a window that has it, and up to
    length - anchor words on either side: the extensions go the same way, and runs of repeated
    ones are the maximal repeats of `length` words or more. What a chunk sends has each
    key once, so a passage in a third of all documents is one entry for each
    chunk; no pair of documents is formed. Seeds only prefilter. Texts are the same if their SHA-256 is; words of up to
    15 bytes are told apart by their bytes, longer ones by 120 bits of their BLAKE2b; and windows are the same if two 64-bit hashes are, each of one half of
    their words' 128 bits, under a secret key that every run draws anew (odds of any false match among n
    windows: n * n / 2^129, and nobody can choose words for one).

    A null or empty text has no words. Repeated rows are copies of each other. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"_key": F.unhex(F.sha2(text, 256))}
    key = tuple(secrets.randbits(64) | 1 for _ in range(4))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    chunks = max(2 * parts, -(-total // chunk_bytes))

    def placed(rows: DataFrame) -> DataFrame:
        """Chunks dealt out evenly: so many to each part, which keeps its place through the steps."""
        return rows.withColumn("part", F.floor(F.col("chunk") * parts / chunks).cast("int")).repartitionById(parts, "part")

    distinct = docs.select(*(c.alias(k) for k, c in keys.items()), text.alias("text")).groupBy("_key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    dealt = placed(distinct.select(F.pmod(F.xxhash64("_key"), F.lit(chunks)).alias("chunk"), "_key", "text", "copies"))
    keys_of = ["part", "chunk"]

    def seeds(table: pa.Table) -> pa.Table:
        c = Chunk(table, length, anchor, key)
        grams, chosen = c.anchors()
        at = np.flatnonzero(chosen)
        copied = np.zeros(len(grams), bool)
        if len(c.copied):
            copied[: len(c.copied)] = c.copied
            copied[len(c.copied) :] = c.copied[-1]
        return _packets(table.column("chunk")[0].as_py(), parts, grams[at, None], copied[at], np.ones(len(at), bool))

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _packets(0, parts, np.zeros((0, 2), np.uint64), np.zeros(0, bool), np.zeros(0, bool))
        c = Chunk(table, length, anchor, key)
        grams, chosen = c.anchors()
        at = np.flatnonzero(chosen)
        at = at[_among(grams[at, None], answers)]
        near = np.flatnonzero(c.near(at))
        copied = c.copied[near]
        return _packets(table.column("chunk")[0].as_py(), parts, c.windows()[near], copied, ~copied)

    made = T.StructType([T.StructField("_key", T.BinaryType()), T.StructField("_kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPANS)])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        kept, n_removed, spans, c = [], [], [], None
        if table.num_rows:
            c = Chunk(table, length, anchor, key)
            hit = np.flatnonzero((_among(c.windows(), answers) & c.whole) | c.copied)
            edge = np.zeros(len(c.hashes) + 1, np.int64)
            edge[hit] += 1
            np.add.at(edge, hit + length, -1)
            stays = np.cumsum(edge)[:-1] == 0
            for i, x in enumerate(table.column("text").cast(pa.binary()).to_pylist()):
                mask, own = stays[c.first[i] : c.first[i + 1]], x.split()
                n_removed.append(len(mask) - int(mask.sum()))
                spans.append(_spans(~mask))
                kept.append(b" ".join(own if not n_removed[-1] else [w for w, s in zip(own, mask.tolist(), strict=True) if s]))
        return pa.table(
            {"_key": table.column("_key"), "_kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(np.diff(c.first) if c else [], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, _SPANS_ARROW)}
        )

    seeded = placed(_answers(dealt.groupBy(keys_of).applyInArrow(seeds, _PACKET), parts, 1))
    repeated = placed(_answers(dealt.groupBy(keys_of).cogroup(seeded.groupBy(keys_of)).applyInArrow(extend, _PACKET), parts, 2))
    done = dealt.groupBy(keys_of).cogroup(repeated.groupBy(keys_of)).applyInArrow(remove, made)
    derive = {**({text_col: lambda c: c} if keep_text else {}), **(derive or {})}
    done = done.select("_key", "n_words", "n_removed", "spans", *(f(F.col("_kept")).alias(f"_new_{n}") for n, f in derive.items()))
    new = ["n_words", "n_removed", "spans", *derive]
    base = docs.withColumns(keys).drop(text_col, *new)
    out = base.join(done, "_key").drop("_key")
    out = out.withColumnsRenamed({f"_new_{n}": n for n in derive})
    return out.select(*dict.fromkeys([*(c for c in docs.columns if c in out.columns), *new]))
