"""Document fingerprints by consistent weighted sampling: the share of equal samples estimates generalised Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches
from .textops import LOWER, NOT_SPACE, arrow_columns, distinct, mix, pieces, words

#: Bytes of text that are sampled at once.
SAMPLED = 8 << 20
#: Terms whose samples are made, and of which samples are compared, at once.
BLOCK = 512
#: Text of a part at most, about; there are more parts than shuffle partitions where the texts ask for them.
PART_BYTES = 64 << 20
#: A sample of a text without words; no other sample is.
NONE = 0xFFFF
#: Steps of the tables of quantiles.
STEPS = 1 << 16


def gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, at the middle of each of STEPS steps: 1 - (1 + x) exp(-x) = u by Newton's method."""
    u = (np.arange(STEPS) + 0.5) / STEPS
    x = np.where(u < 0.3, np.sqrt(2 * u), 2 - np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
    return x


class Sampler:
    """Signatures of texts. Made on the driver and sent to the tasks, so that all machines have the same tables; the rest is exact arithmetic.

    Sample i of a term of weight w (Ioffe): r and c have gamma distributions of shape 2 and b an even one, all
    by the term's hash and i; t = floor(ln w / r + b), and the term of the least ln c - r (t - b) - r
    is the sample, as the pair of it and t. Two weighted sets have the same sample with the
    odds of sum(min) / sum(max). A sample is kept as 16 bits of a hash of its pair.
    """

    def __init__(self, samples: int = 128, seed: int = 1):
        gamma = gamma_quantiles()
        self.samples = samples
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.salts = mix(np.arange(1, samples + 1, dtype=np.uint64) + np.uint64(seed << 32))

    def draw(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each term and sample: the value to minimise above 16 bits that tell its pair."""
        x = mix((hashes[:, None] ^ self.salts[None, :]).ravel()).reshape(len(hashes), self.samples)
        low = np.uint64(STEPS - 1)
        r = self.r[(x & low).astype(np.uint16)]
        log_c = self.log_c[(x >> np.uint64(16) & low).astype(np.uint16)]
        b = ((x >> np.uint64(32) & low).astype(np.float32) + np.float32(0.5)) / np.float32(STEPS)
        # rounded, so that no machine's logarithm differs
        log_w = (np.round(np.log(weights) * (1 << 16)) / (1 << 16)).astype(np.float32)
        t = np.floor(log_w[:, None] / r + b)
        value = log_c - r * (t - b) - r
        bits = np.ascontiguousarray(value).view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        pair = (x >> np.uint64(48)) + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E37) & low
        return ordered << np.uint64(32) | np.minimum(pair, np.uint64(NONE - 1))

    def signatures(self, column: pa.Array) -> np.ndarray:
        """16-bit samples of each text, whose terms are its words (runs of other than white space, A-Z in lower case) and their weights how often they occur."""
        out = np.full((len(column), self.samples), NONE, np.uint16)
        for first_row, offsets, data in pieces(column, SAMPLED):
            data = LOWER[data]
            starts, ends, first = words(data, offsets, NOT_SPACE)
            if not len(starts):
                continue
            number, own = distinct(data, starts, ends, NOT_SPACE)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            term, times = np.unique(row * len(own) + number, return_counts=True)
            row, number = term // len(own), term % len(own)
            # terms of the same word and weight have the same samples
            pair, of = np.unique(number << 32 | times, return_inverse=True)
            hashes, weights = own.hashes().view(np.uint64)[pair >> 32], pair & 0xFFFFFFFF
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(0, len(pair) + BLOCK, BLOCK))
            least = np.full((len(offsets) - 1, self.samples), np.iinfo(np.uint64).max, np.uint64)
            for k, at in enumerate(range(0, len(pair), BLOCK)):
                drawn = self.draw(hashes[at : at + BLOCK], weights[at : at + BLOCK])
                here = np.sort(order[cut[k] : cut[k + 1]])  # in the order of rows
                for a in range(0, len(here), 4 * BLOCK):
                    some = here[a : a + 4 * BLOCK]
                    begin = np.flatnonzero(np.diff(row[some], prepend=-1))
                    rows = row[some[begin]]
                    least[rows] = np.minimum(least[rows], np.minimum.reduceat(drawn[of[some] - at], begin, axis=0))
            there = np.diff(first) > 0
            out[first_row : first_row + len(there)][there] = (least[there] & np.uint64(0xFFFF)).astype(np.uint16)
        return out


def _hex(signatures: np.ndarray) -> list[str]:
    return [s.tobytes().hex() for s in signatures.astype(">u2")]


def fingerprints(docs: DataFrame, text_col: str = "text", samples: int = 128) -> DataFrame:
    """Adds `fingerprint`: four hexadecimal digits for each of `samples` samples of a text's words. Likeness of two is that of their texts' multisets of words.

    Equal texts have equal fingerprints. A null text, an empty one and one without words have ffff for each
    sample. Nothing is shuffled. A column named fingerprint is replaced; others pass.
    """
    sampler = Sampler(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        for batch in batches:
            yield batch, {"fingerprint": _hex(sampler.signatures(batch.column(batch.schema.get_field_index(text_col))))}

    return arrow_columns(docs, run, [T.StructField("fingerprint", T.StringType())])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, from 0 to 1; null if either is."""
    n = F.length(a) / 4
    same = F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / n


def _order_keys(ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of fixed size whose bytes have the order of (id, hash), nulls first."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = 1 + ~null
    for at, x in ((1, np.where(null, 0, ids)), (9, hashes)):
        flipped = x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at : at + 8] = flipped.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 128) -> DataFrame:
    """Fingerprints of each text and of an edited form of it, and how like they are: a test bed for thresholds, on all rows.

    Returns id_col (an integer), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The
    edited text has its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the
    next row's, in the order of id_col, then of a hash of the text; after the last row comes the first.

    Rows are dealt out once, by ranges of (id, hash), and sorted there; the ranges begin at keys found by a
    pass over ids and hashes, of which the driver gets one for each range. The row at which a
    range begins goes to the range before as well, so every row meets its next one. A task holds one Arrow batch.

    A null text is empty. Null ids come first. Repeated ids and rows follow each other, each row
    with its own next. One row alone is its own next; an empty table gives an empty one. Other columns are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    ranges = rows.select("id", "h").repartitionByRange(parts, "id", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "h")).alias("k")).select("k.*").collect()
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next"))])
    if not ranges:
        return spark.createDataFrame([], schema)
    begins = np.unique(_order_keys(*(np.array(x) for x in zip(*((r.id or 0, r.id is None, r.h) for r in ranges), strict=True))))
    sampler = Sampler(samples)

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series, null: pd.Series, hashes: pd.Series) -> pd.Series:
        """The range of each row, and the one before if it begins there."""
        keys = _order_keys(ids.to_numpy(), null.to_numpy(), hashes.to_numpy())
        own = np.searchsorted(begins, keys, side="right") - 1
        return pd.Series([[p, (p - 1) % len(begins)] if first else [p] for p, first in zip(own.tolist(), (begins[own] == keys).tolist(), strict=True)])

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, made = [], [], np.zeros((0, samples), np.uint16)  # the last row, whose next one isn't there yet
        for batch in batches:
            lent = batch.column(0).to_numpy()
            n = int(np.searchsorted(lent, 1)) if len(lent) and lent[-1] else len(lent)
            batch = batch.slice(0, n + 1)  # of the rows that begin the next range, the first is next to the last
            if not batch.num_rows or (n == 0 and not ids):
                continue
            made = np.concatenate([made, sampler.signatures(batch.column(3))])
            ids, texts = ids + batch.column(1).to_pylist(), texts + batch.column(3).to_pylist()
            changed = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
            new = sampler.signatures(pa.array(changed, pa.large_string()))
            near = [(made[:-1] == x).mean(axis=1) for x in (new, made[1:])]
            columns = (pa.array(ids[:-1], pa.int64()), pa.array(list(map(len, texts[:-1])), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()), pa.array(_hex(made[:-1]), pa.string()), pa.array(_hex(new), pa.string()), *map(pa.array, near))
            yield pa.RecordBatch.from_arrays(list(columns), names=schema.names)
            ids, texts, made = (ids[-1:], texts[-1:], made[-1:]) if n == len(lent) else ([], [], made[:0])

    dealt = rows.select(F.posexplode(ranges_of(F.coalesce("id", F.lit(0)), F.col("id").isNull(), "h")).alias("lent", "part"), "id", "h", "text")
    dealt = dealt.repartitionById(len(begins), "part").sortWithinPartitions("lent", "id", "h", "text")
    return dealt.select("lent", "id", "h", "text").mapInArrow(edited, schema)
