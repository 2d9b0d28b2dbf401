"""Text quality by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import LOWER, NOT_SPACE, PIECE, arrow_columns, distinct, mix, pieces, words

_SHAPES, _PAIRS, _WORDS = 768, 1024, 512
FEATURES = _SHAPES + _PAIRS + _WORDS
#: Rows that have features at once, however short.
ROWS = 512

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_LETTER = _UPPER | (_BYTE >= 97) & (_BYTE <= 122)
#: Bytes that are neither letters, digits nor part of a longer character; a lead byte counts for its character.
_MARK = ~(_LETTER | _DIGIT | (_BYTE >= 128))


def _within(kind: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind[data], out=total[1:])
    return total[ends] - total[starts]


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Log counts of word shapes, pairs of shapes and hashed words of each row.

    A shape: how much is in capitals, how many marks, any digit, length,
    and whether the word equals the one before.
    """
    starts, ends, first = words(data, offsets, NOT_SPACE)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    size = ends - starts
    upper, marks, digits = (_within(k, data, starts, ends) for k in (_UPPER, _MARK, _DIGIT))
    capital = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(2 * upper > size - marks, 3, 2)))
    shape = ((capital * 4 + np.minimum(marks, 3)) * 2 + (digits > 0)) * 12 + np.minimum(size, 23) // 2
    number, own = distinct(LOWER[data], starts, ends, NOT_SPACE)
    hashes = mix(own.hashes())[number]
    again = np.zeros(len(starts), bool)
    again[1:] = (number[1:] == number[:-1]) & (row[1:] == row[:-1])
    shape = shape + again * (_SHAPES // 2)
    out = np.bincount(row * FEATURES + shape, minlength=n * FEATURES)
    pair = (mix(shape[:-1].astype(np.uint64) * np.uint64(1000) + shape[1:].astype(np.uint64)) % np.uint64(_PAIRS)).astype(np.int64)
    inside = row[1:] == row[:-1]
    out += np.bincount(row[1:][inside] * FEATURES + _SHAPES + pair[inside], minlength=n * FEATURES)
    out += np.bincount(row * FEATURES + _SHAPES + _PAIRS + (hashes % np.uint64(_WORDS)).astype(np.int64), minlength=n * FEATURES)
    return out.reshape(n, FEATURES).astype(np.float32)


def feature_rows(column: pa.Array, part: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, features) for runs of rows, ROWS at most; texts of any length.

    A very long text is cut between words into parts of `part` bytes, or one word. Each part has the two words before it along, whose
    own features are taken off again, so pairs of words over a cut count and every word knows the one before.
    """
    for first, offsets, data in pieces(column, PIECE // 4, ROWS):
        if len(data) <= part:
            yield first, features(offsets, data)
            continue
        total, before, a = np.zeros((1, FEATURES), np.float32), data[:0], 0
        while a < len(data):
            b = a + part
            while b < len(data) and NOT_SPACE[data[b - 1]] and NOT_SPACE[data[b]]:
                gaps = np.flatnonzero(~NOT_SPACE[data[b : b + part]])
                b += int(gaps[0]) if len(gaps) else part
            now = np.concatenate([before, data[a:b]])
            total += features(np.array([0, len(now)]), now) - features(np.array([0, len(before)]), before)
            starts, ends, _ = words(now, np.array([0, len(now)]), NOT_SPACE)
            before = np.append(now[starts[-2:][0] : ends[-1]], np.uint8(32)) if len(starts) else now[:0]
            a = b
        yield first, total


class LatentVotes:
    """Labelled documents as unit vectors of a truncated singular value decomposition."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int = 48, neighbours: int = 25):
        self.idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))).astype(np.float32) + 1
        weighted = self.weigh(rows)
        rng = np.random.default_rng(0)
        basis = weighted.T @ (weighted @ rng.standard_normal((weighted.shape[1], rank + 16)).astype(np.float32))
        for _ in range(4):
            basis = weighted.T @ (weighted @ np.linalg.qr(basis)[0])
        q = np.linalg.qr(basis)[0]
        _, _, v = np.linalg.svd(weighted @ q, full_matrices=False)
        self.project = (q @ v[:rank].T).astype(np.float32)
        self.vectors, self.labels = self.unit(weighted), labels.astype(np.float32)
        self.neighbours = min(neighbours, len(rows))
        #: votes weigh as if both labels had as many examples
        share = float(labels.mean()) if len(labels) else 0.5
        self.weights = np.where(labels > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)).astype(np.float32)

    def weigh(self, rows: np.ndarray) -> np.ndarray:
        out = np.log1p(rows) * self.idf
        for part in (slice(0, _SHAPES), slice(_SHAPES, _SHAPES + _PAIRS), slice(_SHAPES + _PAIRS, FEATURES)):
            out[:, part] /= np.maximum(np.linalg.norm(out[:, part], axis=1, keepdims=True), 1e-9)
        out[:, _SHAPES + _PAIRS :] *= 0.3
        return out

    def unit(self, weighted: np.ndarray) -> np.ndarray:
        out = weighted @ self.project
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 in the similarity-weighted votes of the nearest (of equally near ones those labelled first); all cosines are computed, in blocks."""
        out = np.full(len(rows), 0.5)
        if not len(self.labels):
            return out
        for a in range(0, len(rows), 512):
            cosine = self.unit(self.weigh(rows[a : a + 512])) @ self.vectors.T
            least = np.partition(cosine, -self.neighbours, axis=1)[:, [-self.neighbours]]
            near, tied = cosine > least, cosine == least
            near |= tied & (np.cumsum(tied, axis=1) <= self.neighbours - near.sum(axis=1, keepdims=True))
            vote = np.where(near, np.square(np.square(np.maximum(cosine, 0))) * self.weights + 1e-9, 0)
            out[a : a + 512] = vote @ self.labels / vote.sum(axis=1)
        return np.clip(out, 0, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out_fold: int = 1, per_label: int = 1000, rank: int = 48, neighbours: int = 25) -> DataFrame:
    """Adds held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5) to `docs`.

    Labels are learned from rows of the folds other than `held_out_fold`; a
    row's fold is crc32 of its id as text, modulo `folds`. Only the text is an
    input of a score. The classifier is fit on at most `per_label` labelled
    texts of each label (those with the least hash of the id), which bounds
    what reaches the driver and what is broadcast; every document is compared
    with all of them.

    Nulls: a null text is empty; a null id counts as empty text; labels other
    than 0 and 1 are ignored. Repeated rows are scored alike; of different texts with one labelled
    id that with the least features is learned. Without labelled
    rows every score is 0.5. Columns of the three names are replaced. An empty
    table gives an empty one.
    """
    def fold(c):
        return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(folds))

    taught = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_label")).where((fold(F.col("_id")) != held_out_fold) & F.col("_id").isNotNull())
    picked = [taught.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_label) for k in (0, 1)]
    sample = picked[0].union(picked[1])
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_label", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for _, block in feature_rows(batch.column(2)) for x in block]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "label", "features"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])
    rows = rows.mapInArrow(measure, schema).groupBy("id", "label").agg(F.min("features").alias("features"))
    got = sorted(rows.collect(), key=lambda r: (r.id, r.label))
    fit = np.frombuffer(b"".join(r.features for r in got), np.float32).reshape(-1, FEATURES)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(LatentVotes(fit, np.array([r.label for r in got], np.int64), rank, neighbours) if got else None, 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        votes = pickle.loads(model.value)
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if votes is not None:
                for first, block in feature_rows(batch.column(batch.schema.get_field_index(text_col))):
                    score[first : first + len(block)] = votes.score(block)
            yield batch, {"score": score, "predicted": (score >= 0.5).astype(np.int32)}

    out = docs.drop("held_out").withColumn("held_out", fold(F.col(id_col)) == held_out_fold)
    return arrow_columns(out, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
