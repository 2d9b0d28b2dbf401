"""Byte-level BPE: encoding of distinct words by a fold of ranked merges, and decoding."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokenize import PATTERN, Splitter, splitter_of
from .shared import small_batches
from .store import HashStore, write_store
from .textops import Words, arrow_columns, distinct, expand, pieces

#: Buckets of the literal rank map; Spark looks a key up in a map entry by entry, so each bucket's map is short.
BUCKETS = 1 << 16
#: Bytes of distinct words that a task remembers, so as not to send them again.
REMEMBERED = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_map(ranks: dict[bytes, int]) -> str:
    """The ranks as a SQL literal: an array of maps, from pieces as Latin-1 text, by the pieces' CRC-32."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.decode("latin-1")
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return json.dumps(buckets)


def encode_word(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of one word as an array: a fold of merges over its bytes.

    A word that is a piece is its id. Otherwise the pieces start as single
    bytes (in Latin-1, a character each) with the ranks of their pairs, and each
    step of the fold joins the first pair of least rank, until no pair has one.
    """
    literal = F.from_json(F.lit(rank_map(ranks)), "array<map<string,int>>")

    def let(value: Column, f) -> Column:
        return F.transform(F.array(value), f)[0]

    def with_ranks(buckets: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.element_at(F.get(buckets, F.crc32(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), piece)

        def step(s: Column, _: Column) -> Column:
            p, r = s["p"], s["r"]

            def join(at: Column) -> Column:
                """Joins the pair at this place (from 1); only the pairs beside it need new ranks."""

                def put(new: Column) -> Column:
                    none = F.array().cast("array<int>")
                    left = F.when(at > 1, F.array(rank(F.concat(F.get(p, at - 2), new)))).otherwise(none)
                    right = F.when(at + 1 < F.size(p), F.array(rank(F.concat(new, F.get(p, at + 1))))).otherwise(none)
                    return F.struct(
                        F.concat(F.slice(p, F.lit(1), at - 1), F.array(new), F.slice(p, at + 2, F.size(p))).alias("p"),
                        F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(p))).alias("r"),
                    )

                return let(F.concat(F.get(p, at - 1), F.get(p, at)), put)

            best = F.array_min(r)
            return F.when(best.isNull(), s).otherwise(let(F.array_position(r, best).cast("int"), join))

        def fold(w: Column) -> Column:
            n = F.length(w)
            single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(w, i, F.lit(1)))
            pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(w, i, F.lit(2))))
            start = F.struct(single.alias("p"), F.when(n > 1, pairs).otherwise(F.array().cast("array<int>")).alias("r"))
            pieces = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["p"])
            return let(rank(w), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(F.transform(pieces, rank)))

        return let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), fold)

    # bound once, so that the plan holds the literal once
    return let(literal, with_ranks)


def encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a word of any length, with a heap of pairs."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or right[i] >= n or end[right[i]] != stop:
            continue
        j = right[i]
        alive[j], end[i], right[i] = False, end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
        for a in (left[i], i):
            if a >= 0 and right[a] < n and (r := ranks.get(word[a : end[right[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[right[a]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _long_words(ranks: dict[bytes, int]):
    """Fills in the ids of words that the fold left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(2)
        if not ids.null_count:
            return batch
        there = ids.is_valid()
        long = [encode_long(w, ranks) for w in batch.column(1).filter(ids.is_null()).cast(pa.binary()).to_pylist()]
        where = there.to_numpy(zero_copy_only=False)
        place = np.where(where, np.cumsum(where) - 1, where.sum() + np.cumsum(~where) - 1)
        ids = pa.concat_arrays([ids.filter(there), pa.array(long, ids.type)]).take(pa.array(place))
        return pa.RecordBatch.from_arrays([*batch.columns[:2], ids], names=["h", "word", "ids"])

    return run


def _matches(splitter: Splitter, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """(starts of the matches in some texts, number of each match among the distinct ones, these)."""
    starts = splitter(offsets, data)
    return starts, *distinct(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)


def _distinct_words(splitter: Splitter):
    """The matches that a task meets for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.array([], pa.string())
        for batch in batches:
            some = [_matches(splitter, offsets, data)[2].array() for _, offsets, data in pieces(batch.column(0))]
            found = pc.unique(pa.concat_arrays([pa.array([], pa.string()), *some]))
            found = found.filter(pc.invert(pc.is_in(found, value_set=seen)))
            seen = pa.concat_arrays([seen, found]) if seen.nbytes < REMEMBERED else found
            yield pa.RecordBatch.from_arrays([found], names=["word"])

    return run


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text_col: str = "text", fold_bytes: int = 512) -> DataFrame:
    """Adds `ids` (array of int): the ids of each text, each match of `pattern` encoded by itself.

    The ids are those of the ranks in `ranks_path` (base64 and rank on a line)
    without special tokens. Every distinct word of the corpus is encoded once, by a
    fold of higher-order functions over a literal rank map (bounded by the
    vocabulary); those over `fold_bytes` bytes, where the fold's cost grows with
    the square, by a heap. The encoded words lie in the shared folder as sorted
    arrays, which the workers map to assemble whole texts: a hash says where a
    word is, its bytes whether it is that word. A row's words are never shuffled. The
    matches of a pattern must cover a text.

    A null or empty text has no ids. Repeated rows are encoded alike. A column
    named ids is replaced. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    ranks, splitter = read_ranks(ranks_path), splitter_of(pattern)
    words = docs.select(text_col).mapInArrow(_distinct_words(splitter), "word string").distinct()
    encoded = words.select(F.xxhash64("word").alias("h"), "word", F.when(F.octet_length("word") <= fold_bytes, encode_word(F.col("word"), ranks)).alias("ids"))
    stored = write_store(encoded, "bpe-words", complete=_long_words(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        store = HashStore(stored)
        for batch in batches:
            values, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
            for _, offsets, data in pieces(batch.column(batch.schema.get_field_index(text_col))):
                starts, number, words = _matches(splitter, offsets, data)
                hashes = words.hashes()
                order = np.argsort(hashes)
                at, n = np.empty((2, len(order)), np.int64)
                at[order], n[order], ids = store.lists(hashes[order], "ids", words.take(order))
                n = n[number]
                values.append(ids[expand(at[number], n)])
                total = np.concatenate([[0], np.cumsum(n)])
                sizes.append(np.diff(total[np.searchsorted(starts, offsets)]))
            ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
            yield batch, {"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), pa.int32()))}

    return arrow_columns(docs, run, [T.StructField("ids", T.ArrayType(T.IntegerType()))])


def bpe_decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of ids: their pieces, one after another."""
    pieces = F.from_json(F.lit(json.dumps([p.decode("latin-1") for p, _ in sorted(ranks.items(), key=lambda x: x[1])])), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(pieces, i + 1)), ""), "ISO-8859-1")
