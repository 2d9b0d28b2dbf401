"""Sorted hash arrays in the shared folder, written by Spark and memory-mapped by workers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import shared_folder, small_batches
from .textops import Words, expand, locate, words_of


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each signed hash: ranges of equal width, in order."""
    return ((hashes >> 32) + (1 << 31)) * shards >> 32


def save(path: str, array: np.ndarray) -> None:
    """Under its name only when whole, so that a task that is run again replaces it with the same."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


class Stored(NamedTuple):
    """A folder of write_store: rows of each shard, the type of each file's numbers, and the sums of columns of integers."""

    folder: str
    rows: list[int]
    types: dict[str, str]
    sums: dict[str, int] | None = None


def save_column(stored: Stored, shard: int, name: str, values: np.ndarray) -> None:
    """A file beside those of write_store, of the type that `stored` says, under its name when whole."""
    files = _Files(stored.folder, shard)
    files.add(name, values.astype(stored.types[name]))
    files.close()


class _Files:
    """Files of one shard, written as batches come and named when whole."""

    def __init__(self, folder: str, shard: int):
        self.own, self.path, self.open, self.at = uuid.uuid4().hex, f"{folder}/{shard}-", {}, {}

    def add(self, name: str, values: np.ndarray) -> None:
        if name not in self.open:
            self.open[name] = open(f"{self.path}{name}.{self.own}.part", "wb")
        self.open[name].write(np.ascontiguousarray(values).data)

    def add_parts(self, name: str, at: np.ndarray, values: np.ndarray) -> None:
        """The parts of `values` between the places `at`; the file of places starts with 0."""
        if name not in self.at:
            self.add(f"{name}-at", np.zeros(1, np.int64))
        done = self.at.get(name, 0)
        self.add(f"{name}-at", at[1:] - at[0] + done)
        self.add(name, values[at[0] : at[-1]])
        self.at[name] = done + int(at[-1] - at[0])

    def close(self) -> None:
        for name, f in self.open.items():
            f.close()
            os.replace(f.name, f"{self.path}{name}")


def write_store(df: DataFrame, what: str, shards: int | None = None, complete: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> Stored:
    """Writes (h, columns ...) in the order of h to arrays in the shared folder, shard by shard.

    h: signed 64-bit hashes, which may repeat. Other columns: numbers, or text or lists of
    numbers (kept as values and places). One shard for each shuffle partition if
    `shards` isn't given; a shard is written as its sorted batches come and never held. `complete` may change batches first.
    """
    spark = df.sparkSession
    small_batches(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, what)
    names = df.columns
    types = {}
    for field in to_arrow_schema(df.schema):
        if pa.types.is_string(field.type):
            types |= {field.name: "uint8", f"{field.name}-at": "int64"}
        elif pa.types.is_list(field.type):
            types |= {field.name: str(np.dtype(field.type.value_type.to_pandas_dtype())), f"{field.name}-at": "int64"}
        else:
            types[field.name] = str(np.dtype(field.type.to_pandas_dtype()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, rows, sums = None, 0, 0, dict.fromkeys(summed, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = complete(batch) if complete else batch
            if files is None:
                shard = int(shard_of(batch.column(0)[:1].to_numpy(), shards)[0])
                files = _Files(folder, shard)
            for name, column in zip(names, batch.columns, strict=True):
                if pa.types.is_string(column.type):
                    files.add_parts(name, *words_of(column))
                elif pa.types.is_list(column.type):
                    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                    files.add_parts(name, at, column.values.to_numpy())
                else:
                    files.add(name, column.to_numpy())
                if name in sums:
                    sums[name] += int(column.to_numpy().sum())
            rows += batch.num_rows
        if files:
            files.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([rows], pa.int64()), pa.array([list(sums.values())], pa.list_(pa.int64()))], names=["shard", "n", "sums"])

    shard = F.expr(f"cast(shiftright((shiftright(h, 32) + 2147483648) * {shards}, 32) AS int)")
    ordered = [c for c in names if c == "h" or df.schema[c].dataType.simpleString() == "string"]
    summed = [c for c in names if c != "h" and types[c].startswith("int") and f"{c}-at" not in types]
    dealt = df.withColumn("_shard", shard).repartitionById(shards, "_shard").sortWithinPartitions(*ordered).select("h", *(c for c in names if c != "h"))
    names = dealt.columns
    rows, sums = [0] * shards, [0] * len(summed)
    for r in dealt.mapInArrow(run, "shard long, n long, sums array<long>").collect():
        rows[r.shard] = r.n
        sums = [a + b for a, b in zip(sums, r.sums, strict=True)]
    return Stored(folder, rows, types, dict(zip(summed, sums, strict=True)))


class HashStore:
    """Look-ups in a folder of write_store."""

    def __init__(self, stored: Stored):
        self.stored, self.shards = stored, len(stored.rows)
        self.open: dict[tuple[int, str], np.ndarray] = {}

    def array(self, shard: int, name: str) -> np.ndarray:
        """A file's numbers, mapped; a shard with rows must have its files."""
        key = shard, name
        if key not in self.open:
            kind, path = self.stored.types[name], f"{self.stored.folder}/{shard}-{name}"
            self.open[key] = np.memmap(path, kind, "r") if self.stored.rows[shard] and os.path.getsize(path) else np.zeros(0, kind)
        return self.open[key]

    def find(self, hashes: np.ndarray, words: Words | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For sorted hashes yields (shard, places in hashes, places in the shard) of those that are there.

        With words (of these hashes, in the same order) their bytes are compared with the column `word`.
        """
        if not len(hashes):
            return
        shard = shard_of(hashes, self.shards)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(hashes)], strict=True):
            number = int(shard[a])
            if not self.stored.rows[number]:
                continue
            own = self.array(number, "h")
            if words is None:
                at = np.searchsorted(own, hashes[a:b])
                at[at == len(own)] = 0
                there = np.flatnonzero(own[at] == hashes[a:b])
            else:
                at = locate(own, Words(self.array(number, "word-at"), self.array(number, "word")), hashes[a:b], Words(words.at[a : b + 1], words.data))
                there = np.flatnonzero(at >= 0)
            yield number, there + a, at[there]

    def lists(self, hashes: np.ndarray, name: str, words: Words | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, sizes, values) of a list column for each of these sorted hashes, all of which must be there."""
        sizes, values, seen = np.zeros(len(hashes), np.int64), [np.zeros(0, self.stored.types[name])], 0
        starts, total = np.zeros(len(hashes), np.int64), 0
        for shard, here, there in self.find(hashes, words):
            at = self.array(shard, f"{name}-at")
            first = np.asarray(at[there])
            sizes[here] = at[there + 1] - first
            starts[here] = total + np.cumsum(sizes[here]) - sizes[here]
            values.append(self.array(shard, name)[expand(first, sizes[here])])
            total += len(values[-1])
            seen += len(here)
        if seen != len(hashes):
            raise KeyError(f"{len(hashes) - seen} hashes aren't in {self.stored.folder}")
        return starts, sizes, np.concatenate(values)


def count_keys(df: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shards: int, at_once: int = 1 << 21) -> DataFrame:
    """(shard, hashes, counts): packets of the distinct signed 64-bit keys that `keys` yields, counted on the map side."""

    def packets(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        shard = shard_of(hashes, shards)
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(shard))
        both = [[x[a:b].tobytes() for a, b in zip(cut, ends, strict=False)] for x in (hashes, counts.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(both[0], pa.binary()), pa.array(both[1], pa.binary())], names=["shard", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = at_once
        for new in keys(batches):
            held.append(np.unique(new, return_counts=True))
            room -= len(held[-1][0])
            if room < 0:
                held = [add_up(held)]
                room = at_once - len(held[0][0])
                if room < at_once // 2:
                    yield packets(*held[0])
                    held, room = [], at_once
        if held:
            yield packets(*add_up(held))

    return df.mapInArrow(run, "shard long, hashes binary, counts binary")


def add_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of some (hashes, counts), sorted, with their sums."""
    hashes = np.concatenate([h for h, _ in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], np.concatenate([c for _, c in parts]).astype(np.int64)[order]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def merge_packets(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """(shard, hashes, counts) of all packets of one shard."""
    parts = [(np.frombuffer(h, np.int64), np.frombuffer(c, np.uint32)) for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True)]
    return table.column("shard")[0].as_py(), *add_up(parts)


def by_shard(df: DataFrame, shards: int, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """run() over all rows of each `shard` (from 0 to shards - 1), one to a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return df.repartitionById(shards, F.col("shard").cast("int")).mapInArrow(each, schema)
