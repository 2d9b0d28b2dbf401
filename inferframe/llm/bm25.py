"""Exact BM25 top-k: inverted indexes of shards, block-max pruning in each, merged with global statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpoint_dir, shared_folder, small_batches
from .store import HashStore, save, write_store
from .textops import ALNUM, Words, distinct_words, expand, locate, words_of

K1, B = 1.2, 0.75
#: Documents of a block, for which each term keeps its bound.
BLOCK = 64
#: Documents are ordered by which of the shard's most frequent terms they use most, of those in over one in COMMON_IN documents.
COMMON, COMMON_IN = 64, 10
#: Terms in over one in FREQUENT_IN of a shard's documents are kept by document, too, the most frequent first, up to so many numbers of 4 bytes (and as many tf).
FREQUENT_IN, FREQUENT_CELLS = 16, 4_000_000
#: Scores of frequent terms that are held at once.
HELD_SCORES = 1 << 20
#: Entries of a query's rarer terms for each block, above which the sum of their bounds says nothing.
MANY = 16
#: What a bound may lack of the score, relatively: scores of frequent terms are of single precision until few documents are left.
SLACK = 1e-5
#: Decimal places of scores, wherever they are compared.
PLACES = 6
#: Bytes of text that a row counts for besides its own.
ROW_BYTES = 64


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word among these terms, words of each row, terms); a term may be there more than once."""
    numbers, sizes, terms, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.binary())], 0
    for _, first, number, own in distinct_words(column, ALNUM):
        numbers.append(number + n)
        sizes.append(np.diff(first))
        terms.append(own.array(pa.binary()))
        n += len(own)
    return np.concatenate(numbers), np.concatenate(sizes), pa.concat_arrays(terms)


def _in_order(numbers: np.ndarray, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(number of each word among the distinct terms in the order of their hashes, these hashes, these terms)."""
    encoded = terms.dictionary_encode()
    own = words_of(encoded.dictionary)
    hashes = own.hashes()
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[encoded.indices.to_numpy().astype(np.int64)][numbers], hashes[order], own.take(order)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the least type that holds them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


class Shard:
    """Inverted index of some documents.

    terms (sorted hashes, and the words themselves) -> entries, one for each block of documents that has
    the term, with its largest tf and the shortest length there -> postings (document, tf).
    Documents that are alike (by their most used common term, then by length) lie together, so that a
    block's bounds are close to what its documents reach. Files hold sizes in place of starts, and all numbers in the least type that fits.
    """

    ARRAYS = ("terms", "entry_block", "entry_tf", "entry_len", "doc", "tf", "length", "ids", "word", "null")
    STARTS = ("term_at", "entry_at", "word_at")

    @classmethod
    def build(cls, ids: pa.Array, numbers: np.ndarray, sizes: np.ndarray, terms: pa.Array) -> Shard:
        self = cls()
        numbers, self.terms, own = _in_order(numbers, terms)
        self.word_at, self.word = own
        alike = cls.order(numbers, sizes, len(own))
        numbers, sizes, ids = numbers[expand((np.cumsum(sizes) - sizes)[alike], sizes[alike])], sizes[alike], ids.take(pa.array(alike))
        self.ids, self.null, self.length = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), sizes.astype(np.uint32)
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        order = np.argsort(numbers, kind="stable")
        numbers, doc = numbers[order], doc[order]
        new_term = np.concatenate([[True], numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, bool)
        new_post = new_term.copy()
        new_post[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(new_post)
        self.tf = np.diff(np.append(at, len(numbers))).astype(np.uint32)
        self.doc, new_term = doc[at], new_term[at]
        block = self.doc // BLOCK
        new_entry = new_term.copy()
        new_entry[1:] |= block[1:] != block[:-1]
        entry = np.flatnonzero(new_entry)
        self.entry_at = np.append(entry, len(at)).astype(np.int64)
        self.entry_block = block[entry]
        self.entry_tf = np.maximum.reduceat(self.tf, entry) if len(entry) else self.tf
        self.entry_len = np.minimum.reduceat(self.length[self.doc], entry) if len(entry) else self.length[:0]
        first = np.flatnonzero(new_term[entry])
        self.term_at = np.append(first, len(entry)).astype(np.int64)
        return self

    @staticmethod
    def order(numbers: np.ndarray, sizes: np.ndarray, n_terms: int) -> np.ndarray:
        """Documents by the common term that they use most, then by length; without common terms by length alone."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        often = np.argsort(-np.bincount(numbers, minlength=n_terms), kind="stable")[:COMMON]
        place = np.full(n_terms, -1)
        place[often] = np.arange(len(often))
        some = place[numbers] >= 0
        holders = np.bincount(np.unique(place[numbers[some]] * len(sizes) + doc[some]) // max(1, len(sizes)), minlength=len(often))
        common = often[holders * COMMON_IN > len(sizes)]
        if not len(common):
            return np.argsort(sizes, kind="stable")
        place[:] = -1
        place[common] = np.arange(len(common))
        at = place[numbers]
        used, times = np.unique((doc.astype(np.int64) * COMMON + at)[at >= 0], return_counts=True)
        most = np.lexsort((used, -times, used // COMMON))  # of each document the term used most, of several the first
        most = used[most[np.flatnonzero(np.diff(used[most] // COMMON, prepend=-1))]]
        favourite = np.zeros(len(sizes), np.int64)
        favourite[most // COMMON] = most % COMMON
        return np.lexsort((sizes, favourite))

    def save(self, path: str) -> None:
        for name in self.ARRAYS:
            values = getattr(self, name)
            save(f"{path}-{name}.npy", values if name in ("terms", "ids", "word") else narrow(values))
        for name in self.STARTS:
            save(f"{path}-{name}.npy", narrow(np.diff(getattr(self, name))))

    @classmethod
    def load(cls, path: str) -> Shard:
        self = cls()
        for name in cls.ARRAYS:
            setattr(self, name, np.load(f"{path}-{name}.npy", mmap_mode="r"))
        for name in cls.STARTS:
            sizes = np.load(f"{path}-{name}.npy")
            starts = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=starts[1:])
            setattr(self, name, starts)
        return self

    def document_frequencies(self) -> np.ndarray:
        return np.diff(self.entry_at[self.term_at])

    def prepare(self, mean_length: float) -> None:
        """Impacts of postings, bounds of entries, and the frequent terms by document, for many queries."""
        norm, n_docs = K1 * (1 - B + B * self.length / mean_length), len(self.length)
        self.docs, self.blocks = np.asarray(self.doc).astype(np.int64), np.asarray(self.entry_block).astype(np.int64)
        self.impact, most = np.asarray(self.tf).astype(np.float64), np.asarray(self.entry_tf).astype(np.float64)
        below = norm[self.docs]
        below += self.impact
        self.impact *= K1 + 1
        self.impact /= below
        self.bound = most * (K1 + 1) / (most + K1 * (1 - B + B * np.asarray(self.entry_len) / mean_length))
        self.term_posts = self.entry_at[self.term_at]
        self.most = np.maximum.reduceat(self.bound, self.term_at[:-1]) if len(self.bound) else self.bound
        df = np.diff(self.term_posts)
        often = np.flatnonzero(df * FREQUENT_IN > n_docs)
        often = often[np.argsort(-df[often], kind="stable")][: FREQUENT_CELLS // max(1, n_docs)]
        self.column = np.full(len(df), -1, np.int64)
        self.column[often] = np.arange(len(often))
        self.norm, self.frequent, self.frequent_tf = norm, np.zeros((len(often), n_docs), np.float32), np.zeros((len(often), n_docs), self.tf.dtype)
        for column, term in enumerate(often.tolist()):
            own = slice(self.term_posts[term], self.term_posts[term + 1])
            self.frequent[column, self.docs[own]], self.frequent_tf[column, self.docs[own]] = self.impact[own], self.tf[own]

    def frequent_scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms give each document, in single precision; a row for each query (places, weights)."""
        weights = np.zeros((len(queries), len(self.frequent)), np.float32)
        for row, (places, weight) in zip(weights, queries, strict=True):
            column = self.column[places]
            row[column[column >= 0]] = weight[column >= 0]
        return weights @ self.frequent

    def search(self, places: np.ndarray, weights: np.ndarray, k: int, floor: float = -np.inf, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best k, or of fewer that reach `floor`; places, weights: of the query's terms in `terms`, whose order is that of sums; frequent: its row of frequent_scores.

        A block's bound is the highest score that the frequent terms give a document there, and the block-max bounds of the
        other terms. Blocks are visited from the highest bound down, a few at first where there is no floor; after these, the k-th best score is
        the threshold, and the blocks whose bound is below it (the pivot and all after it) are
        never opened: none of their postings of rarer terms is read. In an opened block documents that stay below the threshold
        are dropped, and the rest get their exact scores. Scores are rounded to six places before
        any is compared, so that what is found doesn't depend on k.
        """
        n_docs = len(self.length)
        if not len(places) or not n_docs:
            return np.zeros(0, np.int64), np.zeros(0)
        if frequent is None:
            frequent = self.frequent_scores([(places, weights)])[0]
        column = self.column[places]
        rare = np.flatnonzero(column < 0)
        sizes = self.term_at[places[rare] + 1] - self.term_at[places[rare]]
        most = np.maximum.reduceat(frequent, np.arange(0, n_docs, BLOCK))
        whole = sizes.sum() > MANY * len(most)
        if whole:
            bound = most + weights[rare] @ self.most[places[rare]]
        else:
            entries, term = expand(self.term_at[places[rare]], sizes), np.repeat(rare, sizes)
            block = self.blocks[entries]
            bound = np.bincount(block, weights=weights[term] * self.bound[entries], minlength=len(most)) + most
        bound = np.where(bound > 0, bound * (1 + SLACK) + 1e-6, 0)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_docs, best = np.zeros(0, np.int64), np.zeros(0)
        first, last, term_of, summed = self.term_posts[places[rare]], self.term_posts[places[rare] + 1], rare, None
        at, run = 0, max(4, -(-4 * k // BLOCK)) if floor == -np.inf else len(order)
        while at < len(order):
            threshold = max(floor, best[-1] if len(best) == k else -np.inf)
            pivot = at + int(np.searchsorted(-bound[order[at:]], -threshold, side="right"))
            if pivot == at:
                break
            opened = order[at : min(at + run, pivot)]
            at, run = at + len(opened), run * 8
            mask = np.zeros(len(bound), bool)
            mask[opened] = True
            if not whole:
                own = np.flatnonzero(mask[block])
                first, last, term_of = self.entry_at[entries[own]], self.entry_at[entries[own] + 1], term[own]
            if not whole or summed is None:
                posts = expand(first, last - first)
                docs, values = self.docs[posts], self.impact[posts] * np.repeat(weights[term_of], last - first)
                summed = np.bincount(docs, weights=values, minlength=n_docs)
            scores = summed + frequent
            found = np.flatnonzero((scores >= threshold * (1 - SLACK) - 1e-6) & np.repeat(mask, BLOCK)[:n_docs])
            if len(found) > k:  # nothing below the k-th of these can be among the best
                near = scores[found]
                found = found[near >= np.partition(near, len(near) - k)[len(near) - k] * (1 - 2 * SLACK) - 2e-6]
            if len(found):
                exact = self._sums(found, docs, np.repeat(term_of, last - first), values, np.flatnonzero(column >= 0), column, weights)
                scores = np.round(exact, PLACES)
                keep = (exact > 0) & (scores >= threshold)
                best_docs, best = self.best(np.concatenate([best_docs, found[keep]]), np.concatenate([best, scores[keep]]), k)
        return best_docs, best

    def _sums(self, found: np.ndarray, docs: np.ndarray, terms: np.ndarray, values: np.ndarray, often: np.ndarray, column: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of these documents, added up in the order of the query's terms, so that equal documents have equal sums."""
        place = np.full(len(self.length), -1, np.int64)
        place[found] = np.arange(len(found))
        own = np.flatnonzero(place[docs] >= 0)
        tf = self.frequent_tf[column[often][:, None], found].astype(np.float64)
        common = weights[often, None] * (tf * (K1 + 1) / (tf + self.norm[found]))
        doc = np.concatenate([place[docs[own]], np.tile(np.arange(len(found)), len(often))])
        term = np.concatenate([terms[own], np.repeat(often, len(found))])
        value = np.concatenate([values[own], common.ravel()])
        order = np.argsort(term, kind="stable")
        return np.bincount(doc[order], weights=value[order], minlength=len(found))

    def best(self, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(scores) > 4 * k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            docs, scores = docs[scores >= least], scores[scores >= least]
        order = top(np.asarray(self.ids[docs]), np.asarray(self.null[docs]), scores, k)
        return docs[order], scores[order]


def top(ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; ties by id, with null first."""
    return np.lexsort((ids, null == 0, -scores))[:k]


def bm25_top_k(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text", k: int = 10, shard_bytes: int = 24 << 20, block_queries: int = 256, group: int = 4) -> DataFrame:
    """The k best rows of `docs` for each row of `queries`: query_id, rank, doc_id, score.

    Terms are words of ASCII letters, digits and non-ASCII characters, A-Z in
    lower case; a query is a whole text, a repeated term counts as often as it
    occurs. BM25 with k1 1.2, b 0.75 and idf ln(1 + (N - df + 0.5) / (df + 0.5));
    N, df and the mean length are those of all rows. Only rows that share a term
    are found; ties go to the smaller id.

    Each task indexes its rows in shards of `shard_bytes` of text, kept in the
    shared folder (a mounted file system). Document frequencies are summed by
    term over the shards; a hash says where a term is, its bytes whether it is
    that term. Queries are written in blocks of about `block_queries`, or up to four times as many where there are more blocks than cores; a task maps one
    block and about `group` shards and keeps the best k over
    them (so a later shard starts from the threshold that earlier ones reached). One group of shards is searched
    first, and its k-th best scores are where the others start. The tasks' results are merged by rank. Scores have six places wherever they are
    compared. Ids are integers.

    Nulls: a null text has no terms; a query with a null id is left out, a row
    of docs with a null id is found as null. Repeated rows are each found;
    repeated queries give one result for each id, of one of them. Other columns play no
    part. Without rows or queries the result is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    checkpoint_dir(spark)
    folder = shared_folder(spark, "bm25")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]] = []
        room, number = shard_bytes, 0  # a row takes room of its own, so a shard of short ones has no more than it can hold

        def flush() -> pa.RecordBatch:
            ids, numbers, sizes, terms = zip(*held, strict=True)
            shift = np.cumsum([0, *map(len, terms)])
            shard = Shard.build(pa.concat_arrays(ids), np.concatenate([x + a for x, a in zip(numbers, shift, strict=False)]), np.concatenate(sizes), pa.concat_arrays(terms))
            name = f"{TaskContext.get().partitionId()}-{number}"
            shard.save(f"{folder}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(shard.length)], pa.int64()), pa.array([int(shard.length.sum())], pa.int64())], names=["name", "docs", "words"])

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                held.append((part.column(0).cast(pa.int64()), *_terms(part.column(1))))
                room -= part.column(1).nbytes + ROW_BYTES * part.num_rows
                if room < 0:
                    yield flush()
                    held, room, number = [], shard_bytes, number + 1
        if held:
            yield flush()

    shards = docs.select(id_col, text_col).mapInArrow(build, "name string, docs long, words long").checkpoint()
    n_shards, n_docs, n_words = (x or 0 for x in shards.agg(F.count("*"), F.sum("docs"), F.sum("words")).first())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                shard = Shard.load(f"{folder}/{name}")
                for a in range(0, len(shard.terms), 1 << 16):
                    b = min(len(shard.terms), a + (1 << 16))
                    at = shard.word_at[a : b + 1]
                    terms = Words(at - at[0], np.asarray(shard.word[at[0] : at[-1]])).array()
                    yield pa.RecordBatch.from_arrays([terms, pa.array(np.diff(shard.entry_at[shard.term_at[a : b + 1]]))], names=["word", "n"])

    summed = shards.select("name").mapInArrow(frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    stored = write_store(summed.select(F.xxhash64("word").alias("h"), "word", "n"), "bm25-frequencies")

    def save_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            name = f"q{TaskContext.get().partitionId()}-{number}"
            numbers, sizes, terms = _terms(batch.column(1))
            numbers, hashes, own = _in_order(numbers, terms)
            for column, values in (("ids", batch.column(0).cast(pa.int64()).to_numpy()), ("numbers", numbers), ("sizes", sizes), ("hashes", hashes), ("at", own.at), ("data", own.data)):
                save(f"{folder}/{name}-{column}.npy", values)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["block"])

    asked = queries.where(F.col(query_id_col).isNotNull()).select(query_id_col, query_text_col).dropDuplicates([query_id_col])
    n_queries, cores = asked.select(query_id_col).count(), spark.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n_queries // (4 * block_queries)), min(cores, -(-n_queries // block_queries)))
    asked = asked.repartition(n_blocks, query_id_col)
    blocks = asked.mapInArrow(save_queries, "block string").checkpoint()
    mean = max(n_words / max(n_docs, 1), 1e-9)

    def search(first: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = HashStore(stored)
        for batch in batches:
            for block, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, numbers, sizes, hashes, at, data = (np.load(f"{folder}/{block}-{c}.npy") for c in ("ids", "numbers", "sizes", "hashes", "at", "data"))
                words, df = Words(at, data), np.zeros(len(hashes))
                for part, here, there in store.find(hashes, words):
                    df[here] = store.array(part, "n")[there]
                idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
                cut = np.concatenate([[0], np.cumsum(sizes)])
                asked = []
                for i in range(len(ids)):
                    place, n = np.unique(numbers[cut[i] : cut[i + 1]], return_counts=True)
                    asked.append((place, n * idf[place]))
                floors = np.full(len(ids), -np.inf) if first else np.load(f"{folder}/{block}-floors.npy")
                best = [(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0)) for _ in ids]
                for name in names:
                    shard = Shard.load(f"{folder}/{name}")
                    if not len(shard.terms):
                        continue
                    shard.prepare(mean)
                    where = locate(shard.terms, Words(shard.word_at, shard.word), hashes, words)
                    own_terms = [(where[place[where[place] >= 0]], weight[where[place] >= 0]) for place, weight in asked]
                    held = max(1, HELD_SCORES // len(shard.length))
                    for i, (place, weight) in enumerate(own_terms):
                        if i % held == 0:
                            frequent = shard.frequent_scores(own_terms[i : i + held])
                        found, new = shard.search(place, weight, k, floors[i], frequent[i % held])
                        if not len(found):
                            continue
                        had, null, scores = best[i]
                        joined = np.concatenate([had, shard.ids[found]]), np.concatenate([null, shard.null[found]]), np.concatenate([scores, new])
                        order = top(*joined, k)
                        best[i] = tuple(x[order] for x in joined)
                        if len(order) == k:
                            floors[i] = max(floors[i], best[i][2][-1])
                if first:
                    save(f"{folder}/{block}-floors.npy", floors)
                n = [len(x[0]) for x in best]
                doc, null, score = (np.concatenate(x) for x in zip(*best, strict=True)) if best else (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(doc, mask=null > 0), pa.array(score)], names=["query_id", "doc_id", "score"])

    # each block meets each group of shards: names only, which tasks then map
    n_groups = max(1, -(-n_shards // group))
    groups = shards.groupBy(F.pmod(F.xxhash64("name"), F.lit(n_groups)).alias("_group")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    start = groups.agg(F.min("_group")).first()[0] or 0
    meets = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long")))).join(groups, "_group")

    def searched(which: Column, n_tasks: int, first: bool) -> DataFrame:
        return meets.where(which).select("block", "names").repartition(n_tasks).mapInArrow(partial(search, first), "query_id long, doc_id long, score double")

    found = searched(F.col("_group") == start, n_blocks, True)
    if n_groups > 1:
        found = found.checkpoint().unionByName(searched(F.col("_group") != start, (n_groups - 1) * n_blocks, False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
