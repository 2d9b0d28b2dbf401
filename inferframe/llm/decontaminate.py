"""Benchmark decontamination with an FM-index for each shard of the training texts."""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_folder
from .textops import ALNUM, LOWER, Words, arrow_columns, distinct, locate, pieces, words


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with prefix counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            ones = np.zeros(len(now) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(now) - int(ones[-1]))
            now = np.concatenate([now[~bit], now[bit]])
        self.first = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbols, at) - self.first[symbols]


class FmIndex:
    """FM-index of runs of symbols (1 and up); no match crosses the end of a run.

    Suffixes are sorted by prefix doubling; each run starts with a separator
    that sorts by its place, so a comparison ends with its run. Every run's
    first suffix and every `step`-th position are sampled.
    """

    def __init__(self, symbols: np.ndarray, n_symbols: int, step: int = 8):
        n = len(symbols)
        gaps = symbols == 0
        self.symbols_before = np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))
        rank = np.where(gaps, np.cumsum(gaps) - 1, symbols + int(gaps.sum()))
        width = 1
        order = np.argsort(rank, kind="stable")
        while True:
            in_order = rank[order]
            new = np.zeros(n, np.int64)
            new[1:] = np.cumsum(in_order[1:] != in_order[:-1])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if not n or new[-1] == n - 1:
                break
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] + 1
            rank = rank * (n + 1) + ahead
            order = np.argsort(rank, kind="stable")
            width *= 2
        self.bwt = symbols[order - 1]  # before the first stands the last, which no walk reaches
        self.tree = WaveletMatrix(self.bwt, n_symbols + 1)
        sampled = (order % step == 0) | (self.bwt == 0)
        self.sampled = sampled
        self.sample_of = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def step_back(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.symbols_before[symbols - 1] + self.tree.rank(symbols, at)

    def search(self, symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns together: first and last+1 suffix of each.

        A pattern: the `lengths` entries of `symbols` before its place in `ends`.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.bwt), np.int64)
        live = np.arange(len(ends))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            c = symbols[ends[live] - back].astype(np.int64)
            low[live], high[live] = self.step_back(c, low[live]), self.step_back(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Positions of suffixes, walking back to a sampled one."""
        out, walked = np.empty(len(at), np.int64), 0
        open_, now = np.arange(len(at)), at.copy()
        while len(open_):
            done = self.sampled[now]
            out[open_[done]] = self.samples[self.sample_of[now[done]]] + walked
            open_, now = open_[~done], now[~done]
            if len(open_):
                now = self.step_back(self.bwt[now], now)
            walked += 1
        return out


class Patterns:
    """The windows of benchmark items over a vocabulary of their own, in flat arrays.

    symbols: the words of all items, one after another; a window is the `lengths`
    words before its place in `ends`, and belongs to an item, `owner` in `ids`.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        parts = list(pieces(pa.array([t or "" for _, t in items], pa.string()), 1 << 62))
        offsets, data = parts[0][1:] if parts else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
        data = LOWER[data]
        starts, ends, first = words(data, offsets, ALNUM)
        number, own = distinct(data, starts, ends, ALNUM)
        hashes = own.hashes()
        order = np.argsort(hashes)
        self.hashes, self.vocabulary = hashes[order], own.take(order)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(1, len(order) + 1)
        self.symbols = place[number]
        self.ids = sorted({i for i, _ in items})
        names = {x: k for k, x in enumerate(self.ids)}
        sizes = np.diff(first)
        windows = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        of, inside = _expand(windows)
        self.lengths = np.minimum(sizes, window)[of].astype(np.int32)
        self.ends = (first[of] + inside + self.lengths).astype(np.int32)
        self.owner = np.array([names[i] for i, _ in items], np.int32)[of] if len(of) else np.zeros(0, np.int32)

    def symbols_of(self, own: Words) -> np.ndarray:
        """The symbol of each word, by its bytes; 0 for those that no item has."""
        return locate(self.hashes, self.vocabulary, own.hashes(), own) + 1


def _expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each, its place in the group) for groups of these sizes."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def find(patterns: Patterns, symbols: np.ndarray, first: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit mask of the words, document and item of each distinct pair found) in one shard.

    symbols: of all words of the shard, 0 for those that occur in no item. Only
    runs of words that all occur in the benchmark, as long as its shortest
    window, can hold a match; the index is built over these, or over all words if `every`.
    """
    hit = np.zeros(len(symbols), bool)
    none = np.zeros(0, np.int64)
    if not len(patterns.lengths) or not len(symbols):
        return hit, none, none
    other = len(patterns.vocabulary) + 1
    known = symbols > 0 if not every else np.ones(len(symbols), bool)
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    edges = first[(first > 0) & (first < len(symbols))]
    begins[edges] = known[edges]
    stops = known.copy()
    stops[:-1] &= ~known[1:]
    stops[edges - 1] = known[edges - 1]
    run_at, run_end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = run_end - run_at >= patterns.lengths.min()
    run_at, run_end = run_at[long], run_end[long]
    if not len(run_at):
        return hit, none, none
    run, inside = _expand(run_end - run_at + 1)
    word = run_at[run] + inside - 1  # the separator stands before its run
    symbols = np.where(inside == 0, 0, np.where(symbols > 0, symbols, other)[np.maximum(word, 0)])
    index = FmIndex(symbols, other)
    low, high = index.search(patterns.symbols, patterns.ends, patterns.lengths)
    which, inside = _expand(high - low)
    if not len(which):
        return hit, none, none
    at = word[index.locate(low[which] + inside)]
    edge = np.zeros(len(hit) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + patterns.lengths[which], -1)
    hit = np.cumsum(edge)[:-1] > 0
    doc = np.searchsorted(first, at, side="right") - 1
    pairs = np.unique(doc * len(patterns.ids) + patterns.owner[which])
    return hit, pairs // len(patterns.ids), pairs % len(patterns.ids)


def _search(patterns_of: Callable[[int], Patterns], n_blocks: int, text_col: str, shard_bytes: int):
    """Searches each shard for the windows of all blocks, one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_hit, spans, items = [0] * n, [0] * n, [[]] * n, [[]] * n
            for row, offsets, data in pieces(batch.column(batch.schema.get_field_index(text_col)), shard_bytes):
                data = LOWER[data]
                starts, ends, first = words(data, offsets, ALNUM)
                number, own = distinct(data, starts, ends, ALNUM)
                hit, found = np.zeros(len(number), bool), {}
                for k in range(n_blocks):
                    patterns = patterns_of(k)
                    more, doc, item = find(patterns, patterns.symbols_of(own)[number], first)
                    hit |= more
                    for d in np.unique(doc).tolist():
                        found.setdefault(d, set()).update(patterns.ids[x] for x in item[doc == d].tolist())
                n_words[row : row + len(offsets) - 1] = np.diff(first).tolist()
                for d, names in found.items():
                    items[row + d] = sorted(names)
                    h = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[d] : first[d + 1]].astype(np.int8), [0]]))).reshape(-1, 2)
                    n_hit[row + d] = int((h[:, 1] - h[:, 0]).sum())
                    spans[row + d] = [{"first_word": a, "last_word": b - 1, "start": int(starts[first[d] + a] - offsets[d]), "end": int(ends[first[d] + b - 1] - offsets[d])} for a, b in h.tolist()]
            yield batch, {"n_words": n_words, "n_hit": n_hit, "spans": spans, "items": items}

    return run


def _write_blocks(folder: str, window: int):
    """Saves the patterns of each block of items under its number; a task has whole blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[str, str]]] = {}
        for batch in batches:
            for k, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(k, []).append((i, t))
        for k, rows in held.items():
            part = f"{folder}/{k}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                pickle.dump(Patterns(rows, window), f, 5)
            os.replace(part, f"{folder}/{k}")
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64())], names=["k"])

    return run


def _reader(folder: str, there: frozenset[int], window: int) -> Callable[[int], Patterns]:
    """Reads a block's patterns; the last one stays."""
    last: list = [None, None]

    def read(k: int) -> Patterns:
        if last[0] != k:
            last[1] = None  # one at a time
            if k in there:
                with open(f"{folder}/{k}", "rb") as f:
                    last[1] = pickle.load(f)
            else:
                last[1] = Patterns([], window)
            last[0] = k
        return last[1]

    return read


SPANS = T.ArrayType(T.StructType([T.StructField(k, T.LongType()) for k in ("first_word", "last_word", "start", "end")]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20, shard_bytes: int = 8 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """Finds words of `docs` inside any occurrence of a window of a benchmark item.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case. A window is `window` consecutive words of an item, or a whole
    shorter item. Adds to the rows of `docs` (replacing columns of these
    names): n_words, n_hit, spans (merged; first and last word, and start and
    end byte in the UTF-8 text), items (sorted ids of items with an occurring
    window, as strings) and contaminated (n_hit > 0 and share * n_hit >=
    n_words).

    Each `shard_bytes` of training text get an FM-index; all windows are
    searched backward in it together. Words are the same only if their bytes are. Items of more than
    `block_bytes` of text are made into blocks of that size, which tasks write to the shared folder; a shard meets them one at a
    time, in one pass over `docs`. So neither the driver nor a broadcast grows with the benchmark. No row is shuffled.

    Nulls and empty texts have no words. An item without words has no window; a
    null item id is "null". Items that repeat count once for each id.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text_col), F.lit("")).alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t") + 40)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    out = docs.drop("spans", "items", "n_words", "n_hit", "contaminated")
    if n_blocks == 1:
        block = spark.sparkContext.broadcast(pickle.dumps(Patterns([(r.i, r.t) for r in items.collect()], window), 5))
        held: list[Patterns] = []

        def patterns_of(_: int) -> Patterns:
            if not held:
                held.append(pickle.loads(block.value))
            return held[0]
    else:
        folder = shared_folder(spark, "benchmark")
        dealt = items.select(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)).alias("k"), "i", "t").repartition(n_blocks, "k")
        written = dealt.mapInArrow(_write_blocks(folder, window), "k long")
        patterns_of = _reader(folder, frozenset(r.k for r in written.collect()), window)
    out = arrow_columns(out, _search(patterns_of, n_blocks, text_col, shard_bytes), fields)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
