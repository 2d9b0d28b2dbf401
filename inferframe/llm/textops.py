"""Vectorised text work on Arrow batches: words, distinct words, sequence hashes.

All functions work on the UTF-8 bytes of whole texts. Memory stays bounded by
`PIECE` bytes of text plus one document, however large a batch is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import small_batches

#: Bytes of text that are worked on at once.
PIECE = 1 << 20

_BYTE = np.arange(256, dtype=np.int64)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
#: Every byte but space and 0x09 to 0x0D.
NOT_SPACE = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))
#: ASCII letters and digits, and all of a multi-byte character.
ALNUM = (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(column: pa.Array, limit: int = PIECE, rows: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, offsets, bytes) for runs of rows of a text column; null is empty.

    A piece has `limit` bytes at most, or a single row; and no more than `rows` rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, n, first + rows if rows else n)
        yield first, at[first : last + 1] - at[first], data[at[first] : at[last]]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the first word of each row (n+1 entries)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x << np.uint64(n) | x >> np.uint64(64 - n)


def short_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of byte ranges that are shorter than 32 bytes, for which it has no stripes."""
    whole = np.zeros(len(data) // 8 + 5, np.uint64)
    whole.view(np.uint8)[: len(data)] = data

    def eight(at: np.ndarray) -> np.ndarray:
        low, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return whole[low] >> shift | (whole[low + 1] << np.uint64(1)) << (np.uint64(63) - shift)

    h = np.full(len(starts), (seed + int(_P5)) % (1 << 64), np.uint64) + sizes.astype(np.uint64)
    done = np.zeros(len(starts), np.int64)
    for width in (8, 8, 8, 4, 1, 1, 1):
        some = np.flatnonzero(sizes - done >= width)
        if not len(some):
            continue
        value, now = eight(starts[some] + done[some]), h[some]
        if width == 8:
            h[some] = _turn(now ^ _turn(value * _P2, 31) * _P1, 27) * _P1 + _P4
        elif width == 4:
            h[some] = _turn(now ^ (value & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        else:
            h[some] = _turn(now ^ (value & np.uint64(0xFF)) * _P5, 11) * _P1
        done[some] += width
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ h >> np.uint64(32)


class Words(NamedTuple):
    """Distinct words: word i is data[at[i]:at[i + 1]]."""

    at: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def array(self, kind: pa.DataType = pa.string()) -> pa.Array:
        return pa.Array.from_buffers(kind, len(self), [None, pa.py_buffer(self.at.astype(np.int32)), pa.py_buffer(self.data)])

    def hashes(self, seed: int = 42) -> np.ndarray:
        """XXH64 of each word as a signed integer, as Spark's xxhash64 gives it."""
        sizes = np.diff(self.at)
        out = short_hashes(self.data, self.at[:-1], np.minimum(sizes, 31), seed)
        for i in np.flatnonzero(sizes > 31).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.at[i] : self.at[i + 1]].tobytes(), seed)
        return out.view(np.int64)

    def digests(self) -> np.ndarray:
        """128 bits of BLAKE2b of each word, as two unsigned columns: nobody knows two words with the same."""
        data, at = self.data.tobytes(), self.at.tolist()
        return np.frombuffer(b"".join([blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]), np.uint64).reshape(-1, 2)

    def keyed(self, key: tuple[int, ...]) -> np.ndarray:
        """128 bits of each word as two unsigned columns, which a secret key of four odd numbers mixes.

        A word of up to 15 bytes is those bytes and its length, so no two are the same; a longer one is its digest. The
        mixing (three rounds of a Feistel network) is a bijection, in which either column depends on all bits.
        """
        sizes = np.diff(self.at)
        out = np.zeros((len(self), 16), np.uint8)
        short = np.flatnonzero(sizes < 16)
        out[:, 15] = np.where(sizes < 16, sizes, 255)
        n = sizes[short]
        out[np.repeat(short, n), expand(np.zeros(len(n), np.int64), n)] = self.data[expand(self.at[:-1][short], n)]
        for i in np.flatnonzero(sizes > 15).tolist():
            out[i, :15] = np.frombuffer(blake2b(self.data[self.at[i] : self.at[i + 1]].tobytes(), digest_size=15).digest(), np.uint8)
        a, b = (np.ascontiguousarray(x) for x in out.view(np.uint64).T)
        k = [np.uint64(x) for x in key]
        a = a ^ mix(b * k[0] + k[1])
        b = b ^ mix(a * k[2] + k[3])
        a = a ^ mix(b * k[1] + k[2])
        return np.stack([a, b], axis=1)

    def take(self, which: np.ndarray) -> Words:
        sizes = np.diff(self.at)[which]
        return Words(np.concatenate([[0], np.cumsum(sizes)]), self.data[expand(self.at[which], sizes)])


def words_of(column: pa.Array) -> Words:
    """The rows of a text column without nulls, as Words."""
    for _, offsets, data in pieces(column, 1 << 62):
        return Words(offsets, data)
    return Words(np.zeros(1, np.int64), np.zeros(0, np.uint8))


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, Words]:
    """(number of each word among the distinct ones, these), told apart by their bytes.

    The words are the bytes of this kind, or all bytes.
    """
    found = Words(np.concatenate([[0], np.cumsum(ends - starts)]), data if kind is None else data[kind[data]])
    encoded = found.array(pa.binary()).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), words_of(encoded.dictionary)


def distinct_words(column: pa.Array, kind: np.ndarray, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words]]:
    """(first row, first word of each row, number of each word, the distinct words) for pieces of a text column."""
    for row, offsets, data in pieces(column):
        data = LOWER[data] if lower else data
        starts, ends, first = words(data, offsets, kind)
        yield row, first, *distinct(data, starts, ends, kind)


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether a[i] has the bytes of b[j], for each pair of numbers."""
    sizes = a.at[i + 1] - a.at[i]
    same = sizes == b.at[j + 1] - b.at[j]
    some = np.flatnonzero(same)
    sizes = sizes[some]
    differ = a.data[expand(a.at[i[some]], sizes)] != b.data[expand(b.at[j[some]], sizes)]
    same[np.repeat(some, sizes)[differ]] = False
    return same


def locate(hashes: np.ndarray, known: Words, asked: np.ndarray, wanted: Words) -> np.ndarray:
    """The place of each of `wanted` (whose hashes are `asked`) among `known`, which lie in the order of their hashes; -1 if it isn't there.

    Bytes decide: a hash only says where to look.
    """
    out, place, left = np.full(len(asked), -1, np.int64), np.searchsorted(hashes, asked), np.arange(len(asked))
    while len(left):
        left = left[place[left] < len(hashes)]
        left = left[hashes[place[left]] == asked[left]]
        same = same_words(known, place[left], wanted, left)
        out[left[same]] = place[left[same]]
        left = left[~same]
        place[left] += 1
    return out


def window_hashes(hashes: np.ndarray, k: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of each k consecutive entries, by an odd factor; has len(hashes) - k + 1 entries, or none.

    Built by doubling: each step mixes the hashes of two windows that overlap or touch.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, PIECE // 2):
        b = min(n, a + PIECE // 2)
        now, have = mix(hashes[a : b + k - 1]), 1
        while have < k:
            step = min(have, k - have)
            now = mix(now[:-step] * np.uint64(factor) + now[step:])
            have += step
        out[a:b] = now
    return out


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def arrow_columns(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, dict]]], fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns made from whole Arrow batches; other columns pass unchanged.

    make gets the batches and yields (batch, {name: array}). A new column
    replaces one of the same name.
    """
    small_batches(df.sparkSession)
    made = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in made and f.name not in drop]
    schema = T.StructType([*kept, *fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(T.StructType(fields))
        for batch, new in make(batches):
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
            arrays += [new[f.name] if isinstance(new[f.name], pa.Array) else pa.array(new[f.name], type=f.type) for f in types]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(f.name for f in types)])

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of each row; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())
