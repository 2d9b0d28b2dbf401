"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import arrow_columns, texts

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUES = bytes(range(0x80, 0xC0))


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """Digest of each line's key, or None where the key is too short to count.

    The key is the line without white space at its ends, A-Z in lower case.
    """
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):
        key = line.strip(_SPACE)
        # bytes are no fewer than code points, and at most four times as many
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.translate(None, _CONTINUES)) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drops lines whose key occurs in `min_docs` documents, except in the largest id that has it.

    Returns the rows of `docs` with `text` replaced by the kept lines (joined by
    a newline) and the columns n_lines (before dropping) and n_dropped added;
    columns of these names are replaced. Lines are exploded to 128-bit digests,
    distinct ids are counted for each digest, and each document gets the set of
    digests to drop; the kept lines stay in their order.

    Nulls: a null or empty text is one empty line. Rows with a null id lose
    every shared line, which they look up by a digest of their text, and don't count as documents. Repeated rows with one id
    count as one document and are treated alike. An empty table gives an empty
    one. The two groupings combine on the map side, and the joins are on
    columns whose large partitions Spark can split, so a line in a third of all
    documents doesn't meet in one task.
    """
    keys = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_none", T.StringType()), T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType())])
    at = docs.columns.index(id_col)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for i, text in enumerate(texts(batch, "_text")):  # column 2 tells rows without an id apart
                found = {k for k in line_keys(text, min_chars) if k}
                rows.extend([i] * len(found))
                digests.extend(found)
            two = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 2)), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["_id", "_none", "_h1", "_h2"])

    none = F.when(F.col(id_col).isNull(), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    lines = docs.select(docs.columns[at], text_col, none).toDF("_id", "_text", "_none").mapInArrow(explode, keys).distinct()
    shared = lines.groupBy("_h1", "_h2").agg(F.count("_id").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= min_docs)
    drops = lines.join(shared, ["_h1", "_h2"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    drops = drops.groupBy(F.col("_id").alias("_drop_id"), F.col("_none").alias("_drop_none")).agg(F.collect_list(F.struct("_h1", "_h2")).alias("_drops"))
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops["_drop_id"]) & none.eqNullSafe(drops["_drop_none"]), "left").drop("_drop_id", "_drop_none")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_drops"))
            flat = lists.flatten()
            pairs = np.stack([flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)], axis=1).astype("<i8").tobytes() if len(flat) else b""
            sizes = np.concatenate([[0], np.cumsum(np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64))])
            kept_text, n_lines, n_dropped = [], [], []
            for i, text in enumerate(texts(batch, text_col)):
                if sizes[i] == sizes[i + 1]:
                    kept_text.append(text)
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    continue
                gone = {pairs[16 * j : 16 * j + 16] for j in range(sizes[i], sizes[i + 1])}
                old = text.split(b"\n")
                new = [line for line, key in zip(old, line_keys(text, min_chars), strict=True) if key not in gone]
                kept_text.append(b"\n".join(new))
                n_lines.append(len(old))
                n_dropped.append(len(old) - len(new))
            yield batch, {text_col: pa.array(kept_text, pa.binary()).cast(pa.string()), "n_lines": n_lines, "n_dropped": n_dropped}

    fields = [T.StructField(text_col, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return arrow_columns(joined, rebuild, fields, drop=("_drops",)).select(*dict.fromkeys([*docs.columns, "n_lines", "n_dropped"]))
