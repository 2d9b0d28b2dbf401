"""Token-multiset similarity over tables: long form, so that frequent tokens are aggregated and not paired."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_token, token_column, token_line, tokens
from ..sources.files import opened
from ..sources.records import scratch_path

#: Total tokens of the smaller side, up to which it is broadcast.
BROADCAST_TOKENS = 2_000_000
#: Tokens of left texts, and postings that they meet, that a task holds at once (a single text's may be more).
HELD_TOKENS, HELD_POSTINGS = 1 << 18, 1 << 19
#: Bytes of the tokens of pairs of texts that a task compares at once.
HELD_CHARS = 2 << 20
#: Parts that one part of a table is dealt to where the tokens of each id are counted.
PARTS = 16
#: Bytes of an Arrow batch of tokens: a task's Python holds each some times over.
BATCH_BYTES = 4 << 20
#: Similarities from which a search for best matches looks, one after another: each next one asks for longer prefixes.
FALLING = (0.5, 0.25, 0.1, 0.05)


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt out to all of them: a small file is often a single part. Larger ones stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def small_batches(df: DataFrame) -> None:
    """From now on Arrow batches of the session hold BATCH_BYTES at most; a smaller bound that is set in bytes stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = df.sparkSession.conf.get(key).lower().removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")


def by_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts dealt out by id, PARTS parts for each part of the table, so that a task counts the tokens of a few MB of text however large the table is.

    What is grouped by id then needs no other shuffle. Rows of one id stay together; a task with too many of them spills.
    """
    return df.select(id_col, text_col).repartition(PARTS * df.rdd.getNumPartitions(), id_col)


def token_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token) of every token, lower-cased; all in generated code."""
    return df.select(F.col(id_col), F.explode(token_column(F.col(text_col))).alias("_token")).where(is_token(F.col("_token"))).select(id_col, F.lower("_token").alias("token"))


def count_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n) of each row's text."""
    return token_rows(df, id_col, text_col).groupBy(id_col, "token").agg(F.count("*").alias("n"))


def pair_similarity(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """(left_id, right_id, inter, uni, jaccard) of all pairs that share a token.

    right is the small side; if its tokens are few (counted first), they go to the tasks as postings, and left texts meet them
    where they are, split once: nothing of the left side is shuffled, and left rows may repeat.
    With a threshold t pairs are dropped by size, as Jaccard can't be above the ratio of the sizes.
    With a larger right side both are joined by token, and with a threshold only candidates are added up: pairs that share a rare token. Jaccard can't reach t unless
    a pair shares t times the tokens of either, so one of the rarest n - ceil(t * n) + 1 tokens of
    each side (n: with repeats) is shared, rare being by the right side's counts. Both bounds lose no pair.
    """
    r = count_tokens(right, right_id, text_col).withColumnRenamed("n", "m")
    if (r.agg(F.sum("m")).first()[0] or 0) > BROADCAST_TOKENS:
        return _pairs(sized_tokens(left, left_id, text_col), with_sizes(r, right_id, "m", "nb"), left_id, right_id, threshold)
    small_batches(left)
    postings = _Postings(r.where(F.col(right_id).isNotNull()).toPandas(), right_id)
    schema = T.StructType([left.schema[left_id], T.StructField(right_id, right.schema[right_id].dataType), T.StructField("inter", T.LongType()), T.StructField("uni", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, row, item, inter, uni in postings.pairs(batch.column(1), threshold):
                if threshold:
                    near = inter >= threshold * uni - 1e-6
                    row, item, inter, uni = row[near], item[near], inter[near], uni[near]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), postings.ids.take(pa.array(item)), pa.array(inter), pa.array(uni)], names=schema.names)

    out = left.select(left_id, tokens(F.col(text_col)).alias("_tokens")).mapInArrow(run, schema).withColumn("jaccard", F.col("inter") / F.col("uni"))
    return out.where(F.col("jaccard") >= threshold) if threshold else out


def sized_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n, na): counted tokens with the number of all tokens of the row's text, which are split once."""
    rows = df.select(id_col, F.monotonically_increasing_id().alias("_row"), tokens(F.col(text_col)).alias("_tokens"))
    rows = rows.select(id_col, F.size("_tokens").cast("long").alias("na"), F.explode("_tokens").alias("token"))
    counted = rows.groupBy(id_col, "token", "na").agg(F.count("*").alias("n"))
    return counted.select(id_col, "token", "n", "na")


def with_sizes(counted: DataFrame, key: str, n: str, size: str) -> DataFrame:
    return counted.join(counted.groupBy(key).agg(F.sum(n).alias(size)), key)


def _pairs(l: DataFrame, r: DataFrame, left_id: str, right_id: str, threshold: float | None) -> DataFrame:
    """pair_similarity over counted tokens: (left_id, token, n, na) and (right_id, token, m, nb)."""
    if threshold:
        often = r.groupBy("token").agg(F.sum("m").alias("_often"))

        def rarest(rows: DataFrame, key: str, n: str, size: str) -> DataFrame:
            """Rows of the rare tokens: those that the right side lacks come first, then its others by their counts."""
            before = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy("_often", "token").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            return rows.withColumn("_before", before).where(F.col("_before") <= F.col(size) - F.ceil(threshold * F.col(size) - 1e-9)).select(key, "token", size)

        marked = l.join(often, "token", "left").withColumn("_often", F.coalesce("_often", F.lit(0)))
        met = rarest(marked, left_id, "n", "na").join(rarest(r.join(often, "token"), right_id, "m", "nb"), ["token"])
        candidates = met.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select(left_id, right_id).distinct()
        l = candidates.join(l, left_id)
        out = l.join(r, [right_id, "token"])
    else:
        out = l.join(r, ["token"])
    out = out.groupBy(left_id, right_id).agg(F.sum(F.least("n", "m")).alias("inter"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    out = out.select(left_id, right_id, "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("uni"))
    out = out.withColumn("jaccard", F.col("inter") / F.col("uni"))
    return out.where(F.col("jaccard") >= threshold) if threshold else out


class _Postings:
    """The counted tokens of a small side by token, as arrays: postings of token i are those from at[i] to at[i + 1]."""

    def __init__(self, rows: pd.DataFrame, right_id: str):
        ids = np.sort(rows[right_id].unique())
        self.ids, place = pa.array(ids), np.searchsorted(ids, rows[right_id].to_numpy())
        names, token = np.unique(rows["token"].to_numpy(str), return_inverse=True) if len(rows) else (np.zeros(0, str), np.zeros(0, np.int64))
        order = np.argsort(token, kind="stable")
        self.tokens, self.at = pa.array(names, pa.string()), np.searchsorted(token[order], np.arange(len(names) + 1))
        self.item, self.m = place[order], rows["m"].to_numpy(np.int64)[order]
        self.sizes = np.zeros(len(ids), np.int64)
        np.add.at(self.sizes, self.item, self.m)

    def pairs(self, lists: pa.Array, threshold: float | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, row after the last, row, place of the right row, shared tokens, tokens of both together) of all pairs that share a token, some lists at a time.

        With a threshold pairs whose sizes are too unlike are dropped before their tokens are added up.
        """
        n = len(lists)
        first = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        at = 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(first, first[at] + HELD_TOKENS, "right")) - 1)
            found = pc.index_in(lists.values.slice(first[at], first[end] - first[at]), self.tokens)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(at, end), np.diff(first[at : end + 1]))[known]
            key, times = np.unique(row * (len(self.tokens) + 1) + found.drop_null().to_numpy(), return_counts=True)
            row, token = key // (len(self.tokens) + 1), key % (len(self.tokens) + 1)
            sizes = self.at[token + 1] - self.at[token]
            ends = np.searchsorted(row, np.arange(at, end + 1))
            before = np.concatenate([[0], np.cumsum(sizes)])[ends]
            a = at
            while a < end:
                b = max(a + 1, at + int(np.searchsorted(before, before[a - at] + HELD_POSTINGS, "right")) - 1)
                part = slice(ends[a - at], ends[b - at])
                yield (a, b, *self._added(first, row[part], token[part], times[part], sizes[part], threshold))
                a = b
            at = end

    def _added(self, first: np.ndarray, row: np.ndarray, token: np.ndarray, times: np.ndarray, sizes: np.ndarray, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        post = np.arange(sizes.sum()) + np.repeat(self.at[token] - np.cumsum(sizes) + sizes, sizes)
        row, item, shared = np.repeat(row, sizes), self.item[post], np.minimum(np.repeat(times, sizes), self.m[post])
        if threshold:
            na, nb = first[row + 1] - first[row], self.sizes[item]
            like = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
            row, item, shared = row[like], item[like], shared[like]
        pair = row * len(self.ids) + item
        order = np.argsort(pair, kind="stable")
        begin = np.flatnonzero(np.diff(pair[order], prepend=-1))
        inter = np.add.reduceat(shared[order], begin) if len(begin) else begin
        row, item = pair[order][begin] // max(1, len(self.ids)), pair[order][begin] % max(1, len(self.ids))
        return row, item, inter, first[row + 1] - first[row] + self.sizes[item] - inter

    def best(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of the right row most like each list of tokens or -1, similarity)."""
        place, value = np.full(len(lists), -1, np.int64), np.zeros(len(lists))
        for _, _, row, item, inter, uni in self.pairs(lists):
            similar = inter / uni
            order = np.lexsort((item, -similar, row))
            top = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            place[row[top]], value[row[top]] = item[top], similar[top]
        return place, value


def best_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(left_id, keep ..., right_id, jaccard): the most similar right row of each left row; ties go to the smaller right_id. Rows that share no token with any have 0 and no right row.

    A right side of few tokens (counted first) is sent to the tasks as postings; each left text is split once
    in the JVM, meets them where it is, and nothing is shuffled. A larger one is searched by
    rising prefixes (search_best). right_id is a number and repeats in neither way; left rows may repeat.
    """
    r = count_tokens(right, right_id, text_col).withColumnRenamed("n", "m")
    if (r.agg(F.sum("m")).first()[0] or 0) > BROADCAST_TOKENS:
        kept = left.select(left_id, *keep)
        return kept.join(search_best(left, right, left_id, right_id, text_col)[0], left_id, "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(0.0)))
    small_batches(left)
    postings = _Postings(r.where(F.col(right_id).isNotNull()).toPandas(), right_id)
    schema = T.StructType([*(left.schema[c] for c in (left_id, *keep)), T.StructField(right_id, right.schema[right_id].dataType), T.StructField("jaccard", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, similar = postings.best(batch.column(batch.num_columns - 1))
            found = postings.ids.take(pa.array(place, mask=place < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found, pa.array(similar)], names=schema.names)

    return left.select(left_id, *keep, tokens(F.col(text_col)).alias("_tokens")).mapInArrow(run, schema)


def search_best(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """((left_id, right_id, jaccard) of the left rows that share a token with any, pairs added up in each round).

    Exact without all pairs: the first round finds every pair of a similarity of FALLING[0] or more, by the prefix filter of
    pair_similarity. A row that has one is settled, since nothing it hasn't met is as similar; the others
    go on with longer prefixes, and only what is left at the end meets every row that shares a token. left_id doesn't repeat.
    Tokens are counted once, and each round's settled rows written, to the shared folder.
    """
    spark = left.sparkSession

    def kept(df: DataFrame, what: str) -> DataFrame:
        path = scratch_path(spark, what)
        df.write.parquet(path)
        return spark.read.parquet(path)

    r = kept(with_sizes(count_tokens(right, right_id, text_col).withColumnRenamed("n", "m"), right_id, "m", "nb"), "right-tokens")
    rest = kept(sized_tokens(left, left_id, text_col), "left-tokens")
    settled, added = None, []
    for threshold in (*FALLING, None):
        pairs = kept(_pairs(rest, r, left_id, right_id, threshold), "pairs")
        added.append(pairs.count())
        best = pairs.groupBy(left_id).agg(F.max_by(right_id, F.struct("jaccard", -F.col(right_id))).alias(right_id), F.max("jaccard").alias("jaccard"))
        settled = best if settled is None else settled.unionByName(best)
        if threshold:
            rest = rest.join(best.select(left_id), left_id, "left_anti")
    return settled, added


def _differences(a: pa.Array, b: pa.Array, lists: bool) -> pa.StructArray:
    """For each pair of token_line's strings: shared tokens, tokens of both together, how many different ones are removed, changed or added, and with `lists` which, sorted."""
    n = len(a)
    split = [pc.split_pattern(x, " ") for x in (a, b)]
    sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in split]
    coded = pa.concat_arrays([x.flatten() for x in split]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code, row = coded.indices.to_numpy(), np.concatenate([np.repeat(np.arange(n), x) for x in sizes])
    is_token = pc.invert(pc.match_substring_regex(coded.dictionary, "^_*$")).to_numpy(zero_copy_only=False)[code]
    cut = int(is_token[: sizes[0].sum()].sum())
    code, row = code[is_token], row[is_token]
    key, at = np.unique(row * max(1, len(order)) + place[code], return_inverse=True)
    left, right = np.bincount(at[:cut], minlength=len(key)), np.bincount(at[cut:], minlength=len(key))
    row, token = key // max(1, len(order)), key % max(1, len(order))
    out = {"inter": np.bincount(row, np.minimum(left, right), n).astype(np.int64), "uni": np.bincount(row, np.maximum(left, right), n).astype(np.int64)}
    kinds = {"removed": right == 0, "changed": (left > 0) & (right > 0) & (left != right), "added": left == 0}
    out |= {f"n_{k}": np.bincount(row[which], minlength=n).astype(np.int64) for k, which in kinds.items()}
    columns = {k: pa.array(x) for k, x in out.items()}
    if lists:
        for k, which in kinds.items():
            ends = np.concatenate([[0], np.cumsum(out[f"n_{k}"])]).astype(np.int32)
            columns[k] = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(order[token[which]])))
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def compare_texts(df: DataFrame, a: Column, b: Column, given: Column, lists: bool = False) -> DataFrame:
    """Adds jaccard, n_removed, n_changed and n_added of the token multisets of two texts, and with `lists` the struct diff of these sorted tokens.

    Null where `given` isn't true; a null text has no tokens, and two without are alike. Both texts' tokens are found in the JVM where
    their row is, and counted there, HELD_CHARS or a row at a time: neither texts nor tokens are shuffled.
    """
    small_batches(df)
    kinds = ("removed", "changed", "added")
    fields = ["inter long", "uni long", *(f"n_{k} long" for k in kinds), *(f"{k} array<string>" for k in kinds if lists)]

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in fields)}>")
    def compared(x: pa.Array, y: pa.Array) -> pa.Array:
        ends = np.cumsum(sum(pc.binary_length(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in (x, y)))
        parts, at = [], 0
        while at < len(x) or not parts:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_CHARS, "right")))
            parts.append(_differences(x[at:end], y[at:end], lists))
            at = end
        return pa.concat_arrays(parts)

    marked = df.withColumn("_given", F.coalesce(given, F.lit(False)))
    there = F.col("_given")
    found = marked.withColumn("_found", compared(*(token_line(F.when(there, c)) for c in (a, b))))
    inter, uni = F.col("_found.inter"), F.col("_found.uni")
    out = found.withColumn("jaccard", F.when(there, F.when(uni > 0, inter / uni).otherwise(1.0)))
    out = out.withColumns({f"n_{k}": F.when(there, F.col(f"_found.n_{k}")) for k in kinds})
    if lists:
        out = out.withColumn("diff", F.when(there, F.struct(*(F.col(f"_found.{k}").alias(k) for k in kinds))))
    return out.drop("_given", "_found")


def token_changes(left: DataFrame, right: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, token, change) of the tokens that differ in count between two tables' rows of one key: removed, changed or added."""
    a = count_tokens(left, key, text_col)
    b = count_tokens(right, key, text_col).withColumnRenamed("n", "m")
    joined = a.join(b, [key, "token"], "full_outer")
    change = F.when(F.col("m").isNull(), "removed").when(F.col("n").isNull(), "added").when(F.col("n") != F.col("m"), "changed")
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select(key, "token", "change")


def compare_paths(df: DataFrame, column1: str, column2: str, files: DataFrame | None = None, out: str = "jaccard") -> DataFrame:
    """Adds the similarity of the texts in two columns of paths; null where a path or text is blank.

    files: (path, text), read in any way, and joined. Without it each row's two files are opened by the worker that has the row, which must have them
    mounted, some MB at a time: no text is shuffled, and none reaches the driver. A missing file fails the run.
    """
    names = (column1, column2)
    if files is None:
        wanted = dealt(df).withColumns({f"_p{i}": F.col(c) for i, c in enumerate(names)})
        joined = opened(wanted, {f"_p{i}": f"_t{i}" for i in range(2)}, blank=True)
        joined = joined.withColumns({f"_t{i}": F.decode(f"_t{i}", "UTF-8") for i in range(2)})
    else:
        joined = df
        for i, c in enumerate(names):
            f = files.select(F.col("path").alias(f"_p{i}"), F.col("text").alias(f"_t{i}"))
            joined = joined.join(f, F.col(c) == F.col(f"_p{i}"), "left")
        for i, c in enumerate(names):
            missing = (F.col(c) != "") & F.col(f"_p{i}").isNull()
            joined = joined.withColumn(f"_t{i}", F.when(missing, F.raise_error(F.concat(F.lit("no such file: "), F.col(c))).cast("string")).otherwise(F.col(f"_t{i}")))
    given = (F.trim("_t0") != "") & (F.trim("_t1") != "")
    kept = {c: f"_kept{i}" for i, c in enumerate(df.columns)}
    compared = compare_texts(joined.withColumnsRenamed(kept), F.col("_t0"), F.col("_t1"), given)
    return compared.select(*(F.col(k).alias(c) for c, k in kept.items() if c != out), F.col("jaccard").alias(out))
