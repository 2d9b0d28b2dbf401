"""Alignment of two tokenizers: where their tokens end together, and how often ids are linked so in the whole corpus."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .pretokenize import PATTERN
from .shared import new_folder, small_batches
from .store import add_up
from .textops import expand, pieces, words_of

#: Bytes of text that are encoded at once.
ENCODED = 4 << 20
#: Below this code point (Latin letters, all long assigned) the tables of characters of both libraries agree.
AGREED = "\u0250"
#: Buckets of B ids: each holds a part of the pairs' counts, and a row has contributions from each at most.
BUCKETS = 16
#: Bytes of postings that one slot is meant to hold.
SLOT_BYTES = 32 << 20
#: Pairs that a task counts before it sends some.
HELD = 1 << 20

_BYTE = np.arange(256)
#: ASCII characters that are neither white space nor control characters.
_PLAIN = (_BYTE > 0x20) & (_BYTE < 0x7F)


class Side(NamedTuple):
    """One vocabulary: the bytes of id i are data[at[i]:at[i + 1]]."""

    at: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Side:
        return cls(np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int64), np.frombuffer(b"".join(entries), np.uint8))

    def __len__(self) -> int:
        return len(self.at) - 1


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_level(path: str) -> tuple[Tokenizer, Side, tiktoken.Encoding | None]:
    """A byte-level BPE of a JSON file, whose special tokens are plain text in a text; and the same by ranks, if its ids are in the order of its merges."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    letters, vocab, whole = byte_letters(), tokenizer.get_vocab(), json.loads(tokenizer.to_str())
    special = {t["id"] for t in whole["added_tokens"]}
    entries = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        entries[i] = text.encode() if i in special else bytes(letters[c] for c in text)
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in whole["model"]["merges"]]
    split = whole["pre_tokenizer"]
    if merged != sorted(merged) or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
        return tokenizer, Side.of(entries), None
    ranks = {entries[i]: i for i in vocab.values() if i not in special}
    return tokenizer, Side.of(entries), tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def piece_level(path: str) -> tuple[sentencepiece.SentencePieceProcessor, Side]:
    """A SentencePiece model; raises ValueError if a piece goes on over a space, since texts are then not encoded word by word."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces_of = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(p.lstrip("▁").find("▁") > 0 for p in pieces_of):
        raise ValueError("a piece holds a space after a letter")
    return model, Side.of([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_of)])


def chunk_starts(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where texts that lie one after another may be cut: their starts (marked), and each space between two plain ASCII characters.

    No token of either vocabulary goes over such a space, whatever the library's tables of characters, so both encode what is between by itself.
    """
    may = np.zeros(len(data), bool)
    plain = _PLAIN[data]
    may[1:-1] = (data[1:-1] == 32) & plain[:-2] & plain[2:]
    begins = offsets[:-1][np.diff(offsets) > 0]
    may[begins[begins > 0] - 1] = False  # the last character of a text
    whole = np.zeros(len(data), bool)
    whole[begins] = True
    starts = np.flatnonzero(may | whole)
    return starts, whole[starts]


class Aligned(NamedTuple):
    """Some chunks: tokens on both sides, links (as pair keys) and the digest's text of each; whether both sides give back its bytes."""

    n_a: np.ndarray
    n_b: np.ndarray
    link_at: np.ndarray
    links: np.ndarray
    text: pa.Array
    good: np.ndarray


def _gives_back(side: Side, ids: np.ndarray, at: np.ndarray, target: np.ndarray, target_at: np.ndarray) -> np.ndarray:
    """Whether the bytes of each chunk's ids are those of its target."""
    sizes = side.at[ids + 1] - side.at[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    good = ends[at[1:]] - ends[at[:-1]] == np.diff(target_at)
    # only chunks of right length are compared, so places in both correspond
    keep = np.repeat(good, np.diff(at))
    ours = side.data[expand(side.at[ids[keep]], sizes[keep])]
    theirs = target[expand(target_at[:-1][good], np.diff(target_at)[good])]
    chunk = np.repeat(np.flatnonzero(good), np.diff(target_at)[good])
    good[chunk[ours != theirs]] = False
    return good


def _decimals(size: int) -> Side:
    return Side.of([b"%d" % i for i in range(size)])


class Aligner:
    """Encodes and aligns texts; made once for a task."""

    def __init__(self, a_path: str, b_path: str):
        (self.tok_a, self.a, self.ranked), (self.tok_b, self.b) = byte_level(a_path), piece_level(b_path)
        self.decimal = _decimals(max(len(self.a), len(self.b)))

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of each chunk, which a space precedes. Chunks of Latin letters take the faster of two equal ways."""
        fast = self.ranked
        a = [fast.encode_ordinary(" " + c) if fast and max(c) < AGREED else None for c in chunks]
        rest = [i for i, x in enumerate(a) if x is None]
        for i, x in zip(rest, self.tok_a.encode_batch_fast([" " + chunks[i] for i in rest], add_special_tokens=False) if rest else [], strict=True):
            a[i] = x.ids
        return a, self.tok_b.encode(chunks, num_threads=1) if chunks else []

    def align(self, chunks: pa.Array) -> Aligned:
        at, ids = [], []
        for side in self.encode(chunks.to_pylist()):
            at.append(np.concatenate([[0], np.cumsum(np.fromiter(map(len, side), np.int64, len(side)))]))
            ids.append(np.fromiter(chain.from_iterable(side), np.int64, at[-1][-1]))
        own = words_of(chunks)
        target_at = own.at + np.arange(len(own.at))
        target = np.full(target_at[-1], 32, np.uint8)
        inner = np.ones(len(target), bool)
        inner[target_at[:-1]] = False
        target[inner] = own.data
        good = np.ones(len(own), bool)
        for side, x, y in zip((self.a, self.b), ids, at, strict=True):
            good &= _gives_back(side, x, y, target, target_at)
        if not good.all():  # chunks that either side doesn't give back have no tokens from here on
            for k in range(2):
                n = np.diff(at[k])
                ids[k] = ids[k][np.repeat(good, n)]
                at[k] = np.concatenate([[0], np.cumsum(np.where(good, n, 0))])
        ends = [np.cumsum(s.at[x + 1] - s.at[x]) for s, x in zip((self.a, self.b), ids, strict=True)]
        place = np.searchsorted(ends[1], ends[0])  # both end with the last chunk, so this is inside
        of_a = np.flatnonzero(ends[1][place] == ends[0]) if len(place) else place
        of_b = place[of_a]
        links = ids[1][of_b] * len(self.a) + ids[0][of_a]
        return Aligned(np.diff(at[0]), np.diff(at[1]), np.searchsorted(of_a, at[0]), links, self._texts(ids, of_a, of_b, at), good)

    def _texts(self, ids: list[np.ndarray], of_a: np.ndarray, of_b: np.ndarray, at: list[np.ndarray]) -> pa.Array:
        """`a1,a2|b1;` for the groups of each chunk: of_a and of_b are the last tokens of the groups."""
        n_a, n_b = len(ids[0]), len(ids[1])
        group_a = np.searchsorted(of_a, np.arange(n_a))
        group_b = np.searchsorted(of_b, np.arange(n_b))
        before_b, upto_a = np.concatenate([[0], of_b + 1]), of_a + 1
        place_a = np.arange(n_a) + before_b[group_a]
        place_b = np.arange(n_b) + upto_a[group_b]
        every, mark = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        every[place_a], every[place_b] = ids[0], ids[1]
        mark[place_a[of_a]], mark[place_b[of_b]] = ord("|"), ord(";")
        sizes = self.decimal.at[every + 1] - self.decimal.at[every]
        ends = np.cumsum(sizes + 1)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        digit = np.ones(len(out), bool)
        digit[ends - 1] = False
        out[digit] = self.decimal.data[expand(self.decimal.at[every], sizes)]
        out[ends - 1] = mark
        cut = np.concatenate([[0], ends])[at[0] + at[1]]
        return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(out)])

    def texts(self, column: pa.Array) -> Iterator[dict[str, list | np.ndarray]]:
        """Figures of each row, and its distinct pair keys with their multiplicities."""
        for _, offsets, data in pieces(column, ENCODED):
            n = len(offsets) - 1
            starts, whole = chunk_starts(offsets, data)
            stops = np.append(starts[1:], len(data)) if len(starts) else starts
            # a space where a text was cut is the one that precedes the chunk
            found = _slices(data, starts + ~whole, stops).dictionary_encode()
            number, first = found.indices.to_numpy(), np.searchsorted(starts, offsets)
            got = self.align(found.dictionary)
            row = np.repeat(np.arange(n), np.diff(first))
            good = np.diff(first) > 0
            good[row[~got.good[number]]] = False
            number, row = number[good[row]], row[good[row]]
            first = np.searchsorted(row, np.arange(n + 1))
            n_links = np.diff(got.link_at)[number]
            # a row's number before its pairs, to sort all rows at once
            keys = np.repeat(row, n_links) << 40 | got.links[expand(got.link_at[number], n_links)]
            keys.sort()
            begin = np.flatnonzero(np.diff(keys, prepend=-1))
            times, pairs = np.diff(np.append(begin, len(keys))).astype(np.uint32), (keys[begin] & (1 << 40) - 1).astype(np.uint64)
            cut = np.searchsorted(keys[begin] >> 40, np.arange(n + 1)).tolist()
            text = got.text.take(pa.array(number))
            at, shown = np.frombuffer(text.buffers()[1], np.int64)[first].tolist() if len(number) else [0] * (n + 1), memoryview(text.buffers()[2] or b"")
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[first]) for x in (got.n_a[number], got.n_b[number], n_links)]
            yield {
                **dict(zip(_FIGURES[:4], (*sums, sums[2]), strict=True)),
                "groups_sha256": [hashlib.sha256(shown[a : b - 1]).hexdigest() if a < b else "" for a, b in zip(at[:-1], at[1:], strict=True)],
                **{k: [x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for k, x in (("pairs", pairs), ("times", times))},
            }


_COLUMNS = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _slices(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    sizes = stops - starts
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data[expand(starts, sizes)])])


def _buckets(pairs: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """The bucket of each pair: by its B id alone."""
    return (pairs // np.uint64(width)).astype(np.int64) % buckets


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


_POSTED = "bucket int, kind int, slot int, tickets binary, sizes binary, pairs binary, times binary"


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns a row for each row of `docs`: id_col and long n_a, n_b, n_groups, n_links, n_best, count_sum, and groups_sha256.

    A is a byte-level BPE (JSON), which encodes a space and the text; B a SentencePiece model,
    which adds the space itself. Byte places where tokens of both sides end cut a text into
    groups, and link the two tokens that end there (tokens have bytes, so there is
    one of each). A pair's count is the number of its links in all rows; n_best are
    the links whose pair's count is the highest of its B id (ties too), count_sum sums the counts over links.

    Texts are cut at spaces between plain ASCII characters, over which neither side's tokens go, and each
    distinct chunk of a batch is encoded and aligned once. What that gives is written to the shared folder, since
    it costs most. From there each row's distinct pairs and their multiplicities
    (postings) go to the slots of their B id's bucket, and the pairs' counts, added
    up by each task before, to every slot of the bucket: a slot's rows come sorted, counts first, so it holds the
    counts of one bucket (bounded by the vocabularies) and one packet of postings. A bucket has as many slots as
    its postings' bytes ask for, so a B id in a third of all postings is spread over many. Contributions are
    added up by row.

    A null or empty text, and one that either side doesn't give back byte for
    byte, has no tokens: zeros, and an empty groups_sha256. Repeated rows, and rows with the same or no id, are
    rows of their own and all count. An empty table gives an empty one. Other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = len(byte_level(a_path)[1])
    if width * len(piece_level(b_path)[1]) >= 1 << 40:
        raise ValueError("pairs of ids don't fit in 40 bits")
    buckets = BUCKETS
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [T.StructField(k, T.LongType() if v == pa.int64() else T.StringType() if v == pa.string() else T.BinaryType()) for k, v in _COLUMNS.items()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            at = 0
            for got in aligner.texts(batch.column(1)):
                arrays = [pa.array(got[k], kind) for k, kind in _COLUMNS.items()]  # a piece may be less than the batch
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(arrays[0])), *arrays], names=["id", *_COLUMNS])
                at += len(arrays[0])

    path = new_folder(spark, "align")
    made = narrow.mapInArrow(encode, T.StructType([T.StructField("id", docs.schema[id_col].dataType), *fields]))
    made.withColumn("ticket", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = HELD

        def sent() -> pa.RecordBatch:
            pairs, counts = add_up(held)
            order, cut = _by_bucket(_buckets(pairs.view(np.uint64), width, buckets), buckets)
            pairs, counts = pairs[order], counts[order]
            some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
            return _packets(some, 0, [b""] * len(some), [b""] * len(some), [pairs[cut[i] : cut[i + 1]].tobytes() for i in some], [counts[cut[i] : cut[i + 1]].tobytes() for i in some])

        for batch in batches:
            pairs, times = (np.frombuffer(b"".join(batch.column(i).to_pylist()), t) for i, t in ((0, np.int64), (1, np.uint32)))
            held.append(add_up([(pairs, times)]))
            room -= len(held[-1][0])
            if room < 0:
                held = [add_up(held)]
                room = HELD - len(held[0][0])
                if room < HELD // 2:
                    yield sent()
                    held, room = [], HELD
        if held:
            yield sent()

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], np.int64)
            pairs, times = (np.frombuffer(b"".join(batch.column(i).to_pylist()), t) for i, t in ((1, np.uint64), (2, np.uint32)))
            row = np.repeat(np.arange(len(sizes)), sizes)
            order, cut = _by_bucket(_buckets(pairs, width, buckets), buckets)
            pairs, times, row, tickets = pairs[order], times[order], row[order], batch.column(0).to_numpy()
            some, columns = [i for i in range(buckets) if cut[i] < cut[i + 1]], ([], [], [], [])
            for i in some:
                own = slice(cut[i], cut[i + 1])
                begin = np.flatnonzero(np.diff(row[own], prepend=-1))
                for column, values in zip(columns, (tickets[row[own][begin]], np.diff(np.append(begin, len(row[own]))).astype(np.uint32), pairs[own], times[own]), strict=True):
                    column.append(values.tobytes())
            yield _packets(some, 1, *columns)

    # counts go to all slots of their bucket, postings to any one of them
    weight = rows.select("pairs").mapInArrow(lambda batches: _weights(batches, width, buckets), "bucket int, n long")
    weights = {r.bucket: r.n for r in weight.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    slots = [max(1, -(-weights.get(i, 0) * 12 // SLOT_BYTES)) for i in range(buckets)]
    base = [sum(slots[:i]) for i in range(buckets)]
    first, many = (F.get(F.array(*map(F.lit, x)), F.col("bucket")) for x in (base, slots))
    counted = rows.select("pairs", "times").mapInArrow(totals, _POSTED).withColumn("slot", F.explode(F.sequence(first, first + many - 1)))
    posted = rows.select("ticket", "pairs", "times").mapInArrow(postings, _POSTED).withColumn("slot", (first + F.pmod(F.xxhash64("tickets"), many)).cast("int"))
    dealt = counted.unionByName(posted).repartitionById(sum(slots), "slot").sortWithinPartitions("kind")

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], None
        for batch in batches:
            tickets, best, sums = [], [], []
            for kind, *columns in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4, 5, 6)), strict=True):
                pairs = np.frombuffer(columns[2], np.uint64)
                if kind == 0:
                    held.append((pairs, np.frombuffer(columns[3], np.int64)))
                    if sum(len(x) for x, _ in held[1:]) > HELD:
                        held = [add_up(held)]
                    continue
                if known is None:
                    known, counts = add_up(held)
                    held, side = [], known // np.uint64(width)
                    begin = np.flatnonzero(np.diff(side.astype(np.int64), prepend=-1))
                    highest = counts == np.repeat(np.maximum.reduceat(counts, begin), np.diff(np.append(begin, len(side))))
                sizes, times = np.frombuffer(columns[1], np.uint32).astype(np.int64), np.frombuffer(columns[3], np.uint32).astype(np.int64)
                at, start = np.searchsorted(known, pairs), np.cumsum(sizes) - sizes
                tickets.append(np.frombuffer(columns[0], np.int64))
                best.append(np.add.reduceat(times * highest[at], start))
                sums.append(np.add.reduceat(times * counts[at], start))
            if tickets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tickets, best, sums)], names=["ticket", "n_best", "count_sum"])

    added = dealt.mapInArrow(contribute, "ticket long, n_best long, count_sum long").groupBy("ticket").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(added, "ticket", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias(id_col), *_FIGURES, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))


def _packets(some: list[int], kind: int, tickets: list[bytes], sizes: list[bytes], pairs: list[bytes], times: list[bytes]) -> pa.RecordBatch:
    n, names = len(some), [x.split()[0] for x in _POSTED.split(", ")]
    numbers = [pa.array(some, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([0] * n, pa.int32())]
    return pa.RecordBatch.from_arrays([*numbers, *(pa.array(x, pa.binary()) for x in (tickets, sizes, pairs, times))], names=names)


def _weights(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of each bucket."""
    n = np.zeros(buckets, np.int64)
    for batch in batches:
        n += np.bincount(_buckets(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), width, buckets), minlength=buckets)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), pa.array(n)], names=["bucket", "n"])
