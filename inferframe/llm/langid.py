"""Language identification by fusing evidence from text, declaration, address and host."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpoint_dir
from .textops import LOWER, PIECE, pieces

LANGUAGES = ("de", "en", "es", "fr")
#: Hashed byte trigrams of the text model.
DIMS = 1 << 14
#: Added to every count of the text model.
SMOOTH = 0.02
#: Part of an even spread in the model that tells known languages from others: an unseen trigram weighs alike at every corpus size.
EVEN = 0.02

_BYTE = np.arange(256)
#: ASCII letters in lower case, all of longer characters; everything else is a gap.
_SOUND = np.where(((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128), _BYTE, 32).astype(np.int64)


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each byte trigram that isn't blank; texts are framed by gaps."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    framed = np.full(len(data) + 2 * n, 32, np.int64)
    row = np.repeat(np.arange(n), sizes + 2)
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(n), sizes) + 1
    framed[place] = _SOUND[LOWER[data]]
    return _codes(framed, row)


def _codes(framed: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code = (framed[:-2] << 16) + (framed[1:-1] << 8) + framed[2:]
    keep = (row[:-2] == row[2:]) & ((framed[:-2] != 32).astype(np.int8) + (framed[1:-1] != 32) + (framed[2:] != 32) >= 1)
    return row[:-2][keep], (code[keep] * 0x9E3779B1 >> 11) & (DIMS - 1)


def coded(column: pa.Array, part: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row and code of each trigram) of runs of rows, and of parts of a very long text, which overlap by two bytes: no trigram is lost or made by a cut."""
    for first, offsets, data in pieces(column, PIECE // 4):
        if len(offsets) > 2 or len(data) <= part:
            yield first, len(offsets) - 1, *trigrams(offsets, data)
            continue
        for a in range(0, len(data), part):  # the trigrams around the bytes from a to a + part
            inner = _SOUND[LOWER[data[max(0, a - 1) : a + part + 1]]]
            framed = np.concatenate([[32] * (a == 0), inner, [32] * (a + part >= len(data))]).astype(np.int64)
            yield first, 1, *_codes(framed, np.zeros(len(framed), np.int64))


def text_model(docs: DataFrame, text_col: str, declared: Column, languages: Sequence[str]) -> np.ndarray:
    """Log probability of each trigram in each language, less that of an even spread; from all declared texts.

    Two for each language: with SMOOTH added to the counts, and mixed with EVEN of the even spread.

    What reaches the driver is bounded by languages times trigram codes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), DIMS), np.int64)
        for batch in batches:
            spoken = np.array([-1 if x is None else x for x in batch.column(1).to_pylist()], np.int64)
            for first, _, row, code in coded(batch.column(0)):
                own = spoken[first + row]
                total += np.bincount(own[own >= 0] * DIMS + code[own >= 0], minlength=total.size).reshape(total.shape)
        own, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(code), pa.array(total[own, code])], names=["l", "code", "n"])

    number = F.when(F.lit(False), 0)
    for i, lang in enumerate(languages):
        number = number.when(declared == lang, i)
    rows = docs.select(F.col(text_col), number.alias("l")).mapInArrow(run, "l long, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), DIMS))
    for r in rows.toLocalIterator():
        counts[r.l, r.code] = r.n
    smooth = counts + SMOOTH
    mixed = (1 - EVEN) * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) * DIMS + EVEN
    return np.stack([np.log(smooth / smooth.sum(axis=1, keepdims=True) * DIMS), np.log(mixed)]).astype(np.float32)


def _spread(scores: Column) -> Column:
    """Probabilities from log scores."""
    top = F.array_max(scores)
    power = F.transform(F.array(top), lambda t: F.transform(scores, lambda x: F.exp(x - t)))[0]
    return F.transform(F.array(power), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda s, v: s + v)))[0]


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, languages: Sequence[str] = LANGUAGES, confidence: float = 0.5, strength: float = 20.0, floor: float = 0.0, evidence: int = 40) -> DataFrame:
    """Returns a row for each row of `docs`: id, language, posterior, text_language, n_trigrams, rejected.

    Naive Bayes over what is known of a document, each part learned from the whole
    table: the text (hashed byte trigrams, counted by declared language), the
    declared language (markup or metadata; how often each is declared where
    the text says otherwise), the address suffix (last label of the host) and
    the host. The host's prior is smoothed towards its domain's (last two
    labels), that towards the whole table's, `strength` documents' worth each.
    The counts are grouped aggregations of the text's verdicts, joined back on
    narrow rows; a hot host is combined on the map side and its join can be split.
    A text's mean log ratio counts for at most `evidence` trigrams: neighbours
    overlap, and as independent ones they would drown every other evidence. Of languages
    that are equally likely the first in `languages` is taken.

    A document is rejected if it has no letter, if its text isn't more likely in some
    language (mixed with EVEN of an even spread of trigrams) than in the even spread
    itself, by a mean log ratio of `floor`, or if no language reaches `confidence`;
    its language is then "und".

    Nulls: a null text is empty (rejected); a null declaration or host is no
    evidence; a null id is kept. Codes other than `languages` are "other".
    Repeated rows are judged alike. An empty table gives an empty one. Other
    columns play no part.
    """
    checkpoint_dir(docs.sparkSession)
    n = len(languages)
    none = F.lit(None).cast("string")
    said = F.lower(F.substring_index(none if declared is None else declared, "-", 1))
    said = F.when(said.isin(*languages), said).when(said.isNotNull(), "other")
    at = F.lower(none if host is None else host)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(text_model(docs, text_col, said, languages), 5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mixed = pickle.loads(model.value)
        for batch in batches:
            sums, count = np.zeros((batch.num_rows, n)), np.zeros(batch.num_rows, np.int64)
            against = np.zeros((batch.num_rows, n))
            for first, rows, row, code in coded(batch.column(3)):
                count[first : first + rows] += np.bincount(row, minlength=rows)
                for k in range(n):
                    sums[first : first + rows, k] += np.bincount(row, weights=known[k][code], minlength=rows)
                    against[first : first + rows, k] += np.bincount(row, weights=mixed[k][code], minlength=rows)
            mean = sums / np.maximum(count, 1)[:, None]
            weighed = mean * np.minimum(count, evidence)[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n, pa.int32()), pa.array(weighed.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(count), flat, pa.array(against.max(axis=1) / np.maximum(count, 1))], names=["id", "said", "host", "n", "ll", "over"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("said", T.StringType()), T.StructField("host", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ll", T.ArrayType(T.DoubleType())), T.StructField("over", T.DoubleType())])
    rows = docs.select(docs[id_col].alias("id"), said.alias("said"), at.alias("host"), docs[text_col].alias("text")).mapInArrow(score, schema)
    rows = rows.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.when(F.instr("host", ".") > 0, F.substring_index("host", ".", -1))})
    rows = rows.withColumn("guess", F.when((F.col("n") > 0) & (F.col("over") > floor), F.array_position("ll", F.array_max("ll")).cast("int") - 1)).checkpoint()

    def counts(key: str) -> DataFrame:
        of = rows.where(F.col(key).isNotNull() & F.col("guess").isNotNull()).groupBy(F.col(key).alias(f"_{key}"))
        return of.agg(F.array(*(F.count(F.when(F.col("guess") == i, 1)) for i in range(n))).alias(f"n_{key}"))

    # what is bounded by the languages goes to the driver: the whole table's counts, and those of declarations
    total = [1.0 + x for x in rows.agg(*(F.count(F.when(F.col("guess") == i, 1)) for i in range(n))).first()]
    seen = {r._said: r.n_said for r in counts("said").collect()}
    kinds = [*languages, "other"]
    told = {s: [float(np.log((seen.get(s, [0] * n)[i] + 1) / (sum(seen[t][i] for t in seen) + len(kinds)))) for i in range(n)] for s in kinds}
    prior = F.array(*(F.lit(x / sum(total)) for x in total))

    def smoothed(own: Column, parent: Column) -> Column:
        size = F.aggregate(own, F.lit(0).cast("bigint"), lambda s, v: s + v)
        return F.when(own.isNull(), parent).otherwise(F.zip_with(own, parent, lambda c, p: (c + strength * p) / (size + strength)))

    out = rows
    for key in ("domain", "host", "suffix"):
        table = counts(key)
        out = out.join(table, out[key] == table[f"_{key}"], "left").drop(f"_{key}")
    suffix_given = F.when(F.col("n_suffix").isNotNull(), F.zip_with(F.col("n_suffix"), F.array(*map(F.lit, total)), lambda c, t: F.log((c + 1) / (t + 1)))).otherwise(F.array(*[F.lit(0.0)] * n))
    declared_given = F.array(*[F.lit(0.0)] * n)
    for s in kinds:
        declared_given = F.when(F.col("said") == s, F.array(*map(F.lit, told[s]))).otherwise(declared_given)
    host_prior = smoothed(F.col("n_host"), smoothed(F.col("n_domain"), prior))
    out = out.select("id", "n", "ll", "guess", host_prior.alias("hp"), suffix_given.alias("sg"), declared_given.alias("dg"))
    logs = F.zip_with(F.zip_with("ll", F.transform("hp", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with("sg", "dg", lambda a, b: a + b), lambda a, b: a + b)
    out = out.withColumn("p", _spread(logs))
    names = F.array(*map(F.lit, languages))
    best = F.array_max("p")
    rejected = F.col("guess").isNull() | (best < confidence)
    language = F.when(rejected, "und").otherwise(F.element_at(names, F.array_position("p", best).cast("int")))
    guess = F.coalesce(F.get(names, F.col("guess")), F.lit("und"))
    return out.select("id", language.alias("language"), F.round(best, 6).alias("posterior"), guess.alias("text_language"), F.col("n").alias("n_trigrams"), rejected.alias("rejected"))


def page_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def page_declared(html: Column) -> Column:
    """The language a page's markup declares, or null."""
    found = F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]+)", 1)
    return F.when(F.length(found) > 0, found)
